from collections import defaultdict

from pyspark.sql import functions as F

from placebook.llm.linededup import BLANKS, LineRuns, dedup_lines, hash_of


def brute_force(rows):
    holders = defaultdict(set)

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))

    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if len(holders[key(line)]) < 2 or min(holders[key(line)]) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in dedup_lines(df, **options).select("doc_id", "n_lines", "n_dropped", "text").collect())


ROWS = [
    (7, "A common line here\nonly seven has this one\nshort"),
    (3, "a common LINE here  \nshort\n\n"),
    (9, "\ta common line here\r\nA common line here\nÉTÉ ÉTÉ ÉTÉ"),
    (11, "été été été\nÉTÉ ÉTÉ ÉTÉ\nonly seven has this one"),
    (12, None),
    (13, ""),
    (14, "ten chars!\n" * 3000),
    (15, "ten chars!"),
    (16, "own line of mine\nown line of mine"),
]


def test_equals_brute_force_for_any_number_of_batches(spark):
    for batches, fanout in ((1, 2), (3, 2), (6, 2)):
        assert run(spark, ROWS, batches=batches, fanout=fanout) == brute_force(ROWS)


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a line that repeats"), (1, "a line that repeats"), (None, "a line that repeats\nown line here"), (None, "own line here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in dedup_lines(df).collect())
    assert got == [(0, "own line here"), (0, "own line here"), (1, "a line that repeats"), (1, "a line that repeats")]


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x", "n", "h", 5)], "doc_id long, text string, n_lines string, hash string, doc int")
    got = dedup_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "hash", "doc", "n_dropped"]
    assert [tuple(r) for r in got.collect()] == [(1, "x", 1, "h", 5, 0)]
    assert dedup_lines(df.limit(0)).count() == 0


def test_levels_are_merged_and_runs_hold_every_key_once(spark):
    runs = LineRuns(spark, fanout=2, buckets=3)
    for i in range(5):
        lines = spark.range(20).select((F.col("id") + 100 * i).alias("doc"), hash_of(F.concat(F.lit("line number "), F.col("id") + 5 * i)).alias("hash"))
        losing = runs.add(lines)
        assert losing.where("owner is null").count() == (0 if i == 0 else 15)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    hashes = [r.hash for run in runs.runs() for r in run.collect()]
    assert len(hashes) == len(set(hashes)) == 40


def test_runs_are_joined_without_a_shuffle(spark, plan_of):
    runs = LineRuns(spark, buckets=4)
    lines = spark.range(50).select(F.col("id").alias("doc"), hash_of(F.concat(F.lit("line number "), "id")).alias("hash"))
    runs.add(lines)
    batch = lines.groupBy("hash").agg(F.min("doc")).repartition(4, "hash")
    plan = plan_of(batch.join(runs.runs()[0].hint("merge"), "hash", "left_anti"))
    assert "SortMergeJoin LeftAnti" in plan and "Bucketed: true" in plan
    assert plan.count("ENSURE_REQUIREMENTS") <= 1  # of the batch's own grouping
