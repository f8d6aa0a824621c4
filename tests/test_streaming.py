import random

import pytest
from pyspark.sql import functions as F

from placebook.operators.geocode import geocode_table
from placebook.session import new_folder
from placebook.sources.register import read_changes
from placebook.streaming.debounce import debounce, debounce_batches, debounce_stream, open_bursts, read_bursts, read_late, read_watermarks
from placebook.streaming.geocoding import compact_answers, geocode_stream, read_answers, with_answers
from workload.queries import run_stream

INPUTS = "user long, ts timestamp_ntz, seq long, text string"


def inputs(spark, rows):
    """(user, milliseconds, text) in the order typed."""
    df = spark.createDataFrame([(user, at, i, text) for i, (user, at, text) in enumerate(rows)], "user long, ms long, seq long, text string")
    return df.select("user", F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts"), "seq", "text")


def last_inputs(rows, gap=300):
    kept = []
    for user in {row[0] for row in rows}:
        own = sorted((at, i, text) for i, (u, at, text) in enumerate(rows) if u == user)
        ends = [a for a, b in zip(own, own[1:] + [(None,) * 3]) if b[0] is None or b[0] - a[0] >= gap]
        kept += [(user, at, text) for at, _, text in ends if text is not None and len(text.strip()) >= 3]
    return sorted(kept)


def as_rows(df):
    return sorted((row["user"], row["ms"], row["text"]) for row in df.select("user", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "text").collect())


BURSTS = [
    (1, 0, "a"), (1, 299, "ab"), (1, 598, "abc"),  # one burst
    (1, 898, "abcd"),  # exactly the gap later: a new one
    (1, 2000, "ab"),  # too short
    (2, 0, "xyz"), (2, 100, "xy"),  # the last input is too short
    (3, 5, "one"), (3, 5, "two"),  # same moment: the later one counts
    (4, 3_599_900, "before"), (4, 3_600_100, "after the hour"),  # a burst over the edge of a slice
    (5, 3_599_900, "before"), (5, 3_600_200, "after the hour"),
]


def test_debounce(spark):
    assert as_rows(debounce(inputs(spark, BURSTS), "user", "ts", "text", order=["seq"])) == last_inputs(BURSTS)
    assert (4, 3_599_900, "before") not in last_inputs(BURSTS)


@pytest.mark.parametrize("slice_length", ["1 hour", "1 second", "1 millisecond"])
def test_slices_change_nothing(spark, slice_length):
    pick = random.Random(4)
    rows = [(pick.randrange(3), pick.randrange(60_000), pick.choice(["ab", "abc", "abcd"])) for _ in range(600)]
    got = debounce(inputs(spark, rows), "user", "ts", "text", order=["seq"], slice_length=slice_length)
    assert as_rows(got) == last_inputs(rows)


def test_clock_changes_do_not_stretch_silence(spark):
    """Wall-clock inputs around a night without the hour from two to three."""
    df = spark.createDataFrame([(1, "2024-03-10 01:59:59.9", "abc"), (1, "2024-03-10 03:00:00.0", "abcd")], "user long, t string, text string")
    df = df.select("user", F.col("t").cast("timestamp_ntz").alias("ts"), "text")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert debounce(df, "user", "ts", "text").count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_stream_gives_what_the_batch_gives_but_for_open_bursts(spark):
    pick = random.Random(5)
    rows = [(pick.randrange(3), pick.randrange(60_000), pick.choice(["ab", "abc", "abcd"])) for _ in range(600)]
    folder = new_folder(spark, "test-inputs")
    inputs(spark, rows).write.parquet(folder)
    stream = debounce_stream(read_changes(spark, folder, INPUTS), "user", "ts", "text", delay="0 seconds", order=["seq"])
    seen = max(at for _, at, _ in rows)
    written = run_stream(stream)
    assert as_rows(written) == [row for row in last_inputs(rows) if row[1] + 300 <= seen]
    rest = open_bursts(inputs(spark, rows), written, "user", "ts", "text", order=["seq"])
    assert as_rows(written.unionByName(rest)) == last_inputs(rows)


def test_late_files_are_taken_within_the_delay(spark):
    folder = new_folder(spark, "test-late")
    rows = [(1, at * 1000, f"text{at}") for at in (1000, 2000, 50, 4000, 5000)]
    for row in rows:
        inputs(spark, [row]).coalesce(1).write.mode("append").parquet(folder)
    stream = debounce_stream(read_changes(spark, folder, INPUTS, files_per_batch=1), "user", "ts", "text", delay="2 hours", order=["seq"])
    written = run_stream(stream)
    rest = open_bursts(inputs(spark, rows), written, "user", "ts", "text", order=["seq"])
    assert as_rows(written.unionByName(rest)) == last_inputs(rows)


def test_the_stream_alone_gives_what_its_watermark_has_passed(spark):
    """Inputs come in files in any order; each batch's watermark, what came before it and all bursts are checked by hand."""
    pick = random.Random(6)
    files = [[(pick.choice([1, 2, None]), start + pick.randrange(20_000), pick.choice(["ab", "abc", "abcd"])) for _ in range(60)] for start in (0, 30_000, 5_000, 60_000, 10_000, 61_000)]
    files[3].append((1, None, "no time"))
    folder, path = new_folder(spark, "test-inputs"), new_folder(spark, "test-bursts")
    numbered = [[(*row, 100 * f + i) for i, row in enumerate(rows)] for f, rows in enumerate(files)]
    for part in (numbered[:2], numbered[2:]):  # in two runs
        for rows in part:
            df = spark.createDataFrame([(u, t, n, x) for u, t, x, n in rows], "user long, ms long, seq long, text string")
            df.select("user", F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts"), "seq", "text").coalesce(1).write.mode("append").parquet(folder)
        feed = read_changes(spark, folder, INPUTS, files_per_batch=1)
        debounce_batches(feed, path, f"{path}/checkpoint", "user", "ts", "text", "10 seconds", order=["seq"]).awaitTermination()
    mark, marks, late, taken = None, [], [], []
    for rows in numbered:
        dropped = [row for row in rows if row[1] is None or (mark is not None and row[1] < mark)]
        late += dropped
        taken += [row for row in rows if row not in dropped]
        latest = max(t for _, t, _, _ in rows if t is not None) - 10_000
        mark = latest if mark is None else max(mark, latest)
        marks.append(mark)
    millis = F.unix_millis(F.col("watermark").cast("timestamp"))
    assert [tuple(r) for r in read_watermarks(spark, path).orderBy("batch").select("batch", millis).collect()] == list(enumerate(marks))
    assert read_watermarks(spark, path).agg(F.sum("late"), F.sum("inputs")).first() == (len(late), sum(map(len, files)))
    assert sorted(read_late(spark, path).select("seq").toPandas()["seq"]) == sorted(row[3] for row in late) and 5 < len(late) < 200
    ends = []
    for user in (1, 2, None):
        own = sorted((t, n, x) for u, t, x, n in taken if u == user)
        ends += [(user, t, x) for (t, n, x), after in zip(own, own[1:] + [(1 << 60, 0, "")]) if after[0] - t >= 300 and len(x) >= 3 and t + 300 <= mark]
    got = read_bursts(spark, path).select("user", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(ends, key=str) and len(ends) > 50
    assert read_bursts(spark, path).select("batch").distinct().count() > 2


def test_open_bursts_without_a_key_come_once(spark):
    rows = inputs(spark, [(None, 0, "abc"), (1, 0, "abc"), (None, 5000, "abcd")])
    done = debounce(rows, "user", "ts", "text").where("text = 'abc'")
    assert [row.text for row in open_bursts(rows, done, "user", "ts", "text").collect()] == ["abcd"]


def changes(spark, folder, rows, mode="append"):
    schema = "seq long, id long, Longitude string, Latitude string, Geocode boolean, Address string, GeocodedAddress string"
    df = spark.createDataFrame(rows, schema).coalesce(1)
    df.write.mode(mode).parquet(folder)
    return df.schema


def test_answers_of_several_batches(spark):
    folder = new_folder(spark, "test-geocoding")
    gazetteer = spark.createDataFrame([("a", 1.0, 10.0), ("b", 2.0, 20.0)], "address string, lat double, lng double")
    target = spark.createDataFrame(
        [(1, None, None, True, "a", None), (2, None, None, True, "b", None), (3, "5", "5", True, "a", "a"), (4, None, None, True, "lost", None)],
        "id long, Longitude string, Latitude string, Geocode boolean, Address string, GeocodedAddress string",
    )

    def run(feed, target):
        schema = changes(spark, f"{folder}/feed", feed)
        stream = read_changes(spark, f"{folder}/feed", schema, files_per_batch=1)
        geocode_stream(stream, gazetteer, f"{folder}/answers", f"{folder}/checkpoint", ["seq"]).awaitTermination()
        table = with_answers(target, read_answers(spark, f"{folder}/answers"))
        return {row["id"]: (row["Longitude"], row["Latitude"], row["GeocodedAddress"]) for row in table.collect()}

    # In the first batch the second change of row 1 counts.
    got = run([(1, 1, None, None, True, "b", None), (2, 1, None, None, True, "a", None), (3, 3, "5", "5", True, "a", "a"), (4, 4, None, None, True, "lost", None)], target)
    assert got == {1: ("10.0", "1.0", "a"), 2: (None, None, None), 3: ("5", "5", "a"), 4: (None, None, "lost")}
    moved = target.withColumn("Address", F.when(F.col("id") == 1, "b").otherwise(F.col("Address")))
    moved = moved.withColumns({"Longitude": F.expr("if(id = 1, '10.0', Longitude)"), "GeocodedAddress": F.expr("if(id = 1, 'a', GeocodedAddress)")})
    got = run([(5, 2, None, None, True, "b", None), (6, 1, "10.0", "1.0", True, "b", "a")], moved)
    assert got == {1: ("20.0", "2.0", "b"), 2: ("20.0", "2.0", "b"), 3: ("5", "5", "a"), 4: (None, None, "lost")}
    by_hand = target.withColumn("Longitude", F.expr("if(id in (1, 2), '99', Longitude)"))
    answers = read_answers(spark, f"{folder}/answers")
    for known in (answers, compact_answers(answers, f"{folder}/compact")):
        kept = {row["id"]: row["Longitude"] for row in with_answers(by_hand, known).collect()}
        assert kept == {1: "99", 2: "99", 3: "5", 4: None}
    assert [row["batch"] for row in read_answers(spark, f"{folder}/answers").select("batch").distinct().orderBy("batch").collect()] == [0, 1]


def test_stream_and_batch_agree(spark, sf_dir):
    """But for the rows that the query edits by hand afterwards."""
    from workload.queries import geocode_stream_query, geocoded_columns
    from workload.standins import view

    batch = geocoded_columns(geocode_table(view(spark, sf_dir, "places"), view(spark, sf_dir, "gazetteer")))
    rows = lambda df: sorted(df.where("id % 10 <> 0").collect(), key=lambda row: row["id"])
    assert rows(geocode_stream_query(spark, sf_dir)) == rows(batch)
