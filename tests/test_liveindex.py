import pytest

from placebook.operators.liveindex import LiveIndex
from placebook.session import new_folder
from placebook.sinks.versions import AlreadyWritten
from tests.test_search import brute_force, tables

RECORD = "id long, nom string, adresse string"


def found(df):
    return sorted(tuple(row) for row in df.collect())


def test_changes_equal_a_new_index(spark):
    queries, records, queries_df, _ = tables(spark, 21, n_records=120, n_queries=25)
    rows = {row[0]: row for row in records}
    ids = sorted(rows)
    frame = lambda part: spark.createDataFrame([rows[i] for i in part], RECORD)
    index = LiveIndex.create(spark, new_folder(spark, "live"), fanout=3)
    assert found(index.search(queries_df)) == []
    index.put(frame(ids[:60]), ("feed", 0))
    index.put(frame(ids[60:]), ("feed", 1))
    assert index.put(frame(ids[:5]), ("feed", 1)) == 2  # a repeated batch
    first = brute_force(queries, rows.values())
    # The smallest ids of texts that many records share go, and some records come again with other texts.
    gone = [i for i in ids[:30] if i % 3 == 0]
    assert index.remove(spark.createDataFrame([(i,) for i in [*gone, 5000, None]], "id long")) == 3
    rows = {i: row for i, row in rows.items() if i not in gone}
    assert found(index.search(queries_df)) == brute_force(queries, rows.values())
    # From here on three segments are merged into one.
    again = {i: (i, "mairie de paris", "gare de lyon") for i in [*gone[:3], *ids[31:36], 3000]}
    rows |= again
    index.put(spark.createDataFrame([*again.values(), (None, "x", "y")], RECORD))
    assert [s.level for s in index.version().segments] == [1] and len(index.version(3).segments) == 2
    assert found(index.search(queries_df)) == brute_force(queries, rows.values())
    assert found(index.search(queries_df, 3, number=2)) == [row for row in first if row[1] <= 3]
    assert found(index.records()) == sorted(rows.values())
    with pytest.raises(ValueError, match="too few"):
        index.search(queries_df, 9)
    with pytest.raises(AlreadyWritten):
        LiveIndex.create(spark, index.path)


def test_a_search_reads_the_segments_it_needs(spark):
    index = LiveIndex.create(spark, new_folder(spark, "live"))
    index.put(spark.createDataFrame([(1, "mairie", "paris"), (2, "gare", "nantes")], RECORD))
    index.put(spark.createDataFrame([(7, "piscine", "lyon")], RECORD))
    typed = spark.createDataFrame([(1, "piscine"), (1, "piscine"), (2, None), (3, "zzzz")], "qid long, text string")
    assert [(s.low, s.high) for s in index.needed(typed)] == [(7, 7)]
    assert found(index.search(typed)) == [(1, 1, 7, 0.007943), (1, 1, 7, 0.007943)]
    index.remove(spark.createDataFrame([(7,)], "id long"))
    assert found(index.search(typed)) == [] and index.version().segments[0].gone == []
    assert index.put(spark.createDataFrame([], RECORD)) == 4 and len(index.version().segments) == 2
