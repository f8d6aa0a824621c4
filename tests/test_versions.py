import random

import pytest
from pyspark.sql import functions as F

from placebook.session import new_folder
from placebook.sinks import versions
from placebook.sinks.versions import AlreadyWritten, VersionedTable, update_stream
from placebook.sources.register import read_changes

SCHEMA = "id long, kind string, a int, `b.c` string"


def rows(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


@pytest.fixture
def table(spark):
    df = spark.createDataFrame([(i, f"k{i}", i, None) for i in range(10)] + [(None, "no key", 0, "x")], SCHEMA)
    return VersionedTable.create(df, new_folder(spark, "versions"), ["id"])


def test_old_and_new_versions(spark, table):
    before = rows(table.read())
    updates = spark.createDataFrame([(3, 1, 30, "x"), (3, 2, None, ""), (99, 1, 1, "lost"), (None, 1, 1, "no")], "id long, step int, a int, `b.c` string")
    assert table.update(updates, ["a", "b.c"], ["step"]) == 1
    pinned = table.read(0)
    assert rows(pinned) == before
    expected = sorted([(3, "k3", None, "") if row[0] == 3 else row for row in before], key=str)
    assert rows(table.read()) == expected and table.read().columns == ["id", "kind", "a", "b.c"]
    table.compact()
    assert rows(table.read()) == expected and rows(pinned) == before and rows(table.read(1)) == expected
    assert table.versions() == [0, 1, 2] and table.version().changes == []


def test_a_repeated_batch_has_no_second_effect(spark, table):
    update = lambda a: spark.createDataFrame([(1, 1, a)], "id long, step int, a int")
    assert table.update(update(100), ["a"], ["step"], ("w", 0)) == 1
    assert table.update(update(200), ["a"], ["step"], ("w", 1)) == 2
    assert table.update(update(100), ["a"], ["step"], ("w", 0)) == 2
    assert table.update(update(300), ["a"], ["step"], ("other", 0)) == 3
    assert [row.a for row in table.read().where("id = 1").collect()] == [300]
    assert table.put(spark.createDataFrame([(50, "new", 1, "n")], SCHEMA), ["a"], ("w", 1)) == 3


@pytest.mark.parametrize("seed", [1, 2])
def test_many_changes_equal_plain_ones(spark, table, monkeypatch, seed):
    monkeypatch.setattr(versions, "FOLD_FROM", 4)
    rng = random.Random(seed)
    state = {row[0]: row for row in rows(table.read()) if row[0] is not None}
    states = {0: dict(state)}
    for step in range(9):
        ids = rng.sample(range(16), 4)
        what = rng.choice(["a", "b.c", "put", "drop"])
        if what == "put":
            number = table.put(spark.createDataFrame([(i, f"p{step}", step, "p") for i in ids], SCHEMA), ["a"])
            state |= {i: (i, f"p{step}", step, "p") for i in ids}
        elif what == "drop":
            number = table.drop(spark.createDataFrame([(i,) for i in ids], "id long"))
            state = {i: row for i, row in state.items() if i not in ids}
        else:
            value = step if what == "a" else f"s{step}"
            number = table.update(spark.createDataFrame([(i, value) for i in ids], f"id long, `{what}` {'int' if what == 'a' else 'string'}").withColumn("o", F.lit(0)), [what], ["o"])
            place = 2 if what == "a" else 3
            state = {i: (*row[:place], value, *row[place + 1 :]) if i in ids else row for i, row in state.items()}
        if step == 5:
            number = table.compact()
        states[number] = dict(state)
    for number, known in list(states.items())[::3] + [(table.version().number, state)]:
        got = [row for row in rows(table.read(number)) if row[0] is not None]
        assert got == sorted(known.values(), key=str)
    assert len(table.version().changes) < 4


def test_writers_at_once(spark, table):
    """Another writer's version comes first: its changes stay, one's own follow."""
    put = lambda i, a: spark.createDataFrame([(i, "w", a, "w")], SCHEMA)
    other = VersionedTable(spark, table.path)
    written = table._files.write
    inserted = []

    def late(number, content):
        if not inserted:
            inserted.append(other.put(put(77, 1), ["a"]))
            other.compact()
        return written(number, content)

    table._files.write = late
    table.put(put(77, 2), ["a"])
    assert [row.a for row in table.read().where("id = 77").collect()] == [2]
    inserted.clear()
    late_update = lambda: other.update(spark.createDataFrame([(77, 5, 0)], "id long, a int, o int"), ["a"], ["o"])

    def later(number, content):
        if not inserted:
            inserted.append(late_update())
        return written(number, content)

    table._files.write = later
    table.compact()
    assert [row.a for row in table.read().where("id = 77").collect()] == [5] and table.version().changes == []
    with pytest.raises(AlreadyWritten):
        table._files.write(0, {})
    with pytest.raises(AlreadyWritten):
        VersionedTable.create(put(1, 1), table.path, ["id"])
    with pytest.raises(ValueError):
        VersionedTable.create(put(1, 1).select("id"), new_folder(spark, "versions"), ["id"])


def test_few_changes_do_not_shuffle_the_base(spark, table, plan_of):
    table.update(spark.createDataFrame([(1, 5, 0)], "id long, a int, o int"), ["a"], ["o"])
    plan = plan_of(table.read())
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_empty_changes_and_tables(spark, table):
    before = rows(table.read())
    table.update(spark.createDataFrame([], "id long, a int, o int"), ["a"], ["o"])
    table.drop(spark.createDataFrame([], "id long"))
    assert rows(table.read()) == before
    empty = VersionedTable.create(spark.createDataFrame([], SCHEMA), new_folder(spark, "versions"), ["id"])
    assert rows(empty.read()) == []
    empty.put(spark.createDataFrame([(1, "x", 1, "y"), (1, "x", 2, "z"), (None, "x", 1, "y")], SCHEMA), ["a"])
    assert rows(empty.read()) == [(1, "x", 2, "z")]


def test_a_stream_of_updates(spark, table):
    folder = new_folder(spark, "stream")
    for batch in ([(1, 1, 11), (2, 1, 21)], [(1, 1, 12)], [(2, 1, 22), (2, 2, 23)]):
        feed = spark.createDataFrame(batch, "id long, step int, a int").coalesce(1)
        feed.write.mode("append").parquet(f"{folder}/feed")
        stream = read_changes(spark, f"{folder}/feed", feed.schema, files_per_batch=1)
        update_stream(stream, table, ["a"], ["step"], f"{folder}/checkpoint", "feed").awaitTermination()
    assert {row.id: row.a for row in table.read().where("id in (1, 2)").collect()} == {1: 12, 2: 23}
    assert {row.id: row.a for row in table.read(1).where("id in (1, 2)").collect()} == {1: 11, 2: 21}
    assert table.version().batches == {"feed": 2}
