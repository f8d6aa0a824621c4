import pytest
from pyspark.sql import functions as F

from placebook.operators.ids import assign_ids
from placebook.operators.joins import count_keys, deal_rows, hot_keys, skew_join
from placebook.operators.latest import first_match, last_per_id
from placebook.operators.update import update_by_id
from placebook.session import fits_broadcast


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows have key 7, a third none."""
    return spark.range(3000).select("id", F.expr("case id % 3 when 0 then 7 when 1 then null else id % 100 end").alias("k"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_is_a_join(spark, skewed, how):
    small = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    small = small.unionByName(spark.range(3).select(F.lit(7).cast("long").alias("k"), F.col("id").alias("v")))
    expected = sorted(skewed.join(small, "k", how).collect(), key=str)
    assert sorted(skew_join(skewed, small, ["k"], how).collect(), key=str) == expected
    assert sorted(skew_join(skewed, small, ["k"], how, limit=0).collect(), key=str) == expected


def test_hot_rows_are_spread(spark, skewed):
    small = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    hot = {row["k"]: (row["pieces"], row["other_pieces"]) for row in hot_keys(count_keys(skewed.where("k is not null"), ["k"]), count_keys(small, ["k"]), ["k"]).collect()}
    assert set(hot) == {7} and hot[7][0] >= 2 and hot[7][1] == 1
    plan = skew_join(skewed, small, ["k"], "left", limit=0)._jdf.queryExecution().toString()
    assert "_piece" in plan


def most_in_a_task(df):
    return [row["count"] for row in df.groupBy(F.spark_partition_id()).count().collect()]


@pytest.mark.parametrize("alike", [False, True])
def test_a_key_that_the_other_side_holds_often_is_spread(spark, alike):
    """One key of 11 rows meets 40,000 rows of the second side, which may all be equal."""
    large = spark.range(440).select((F.col("id") % 40).alias("k"), "id")
    small = spark.range(40_000).select(F.lit(7).cast("long").alias("k"), F.lit(0).alias("v") if alike else F.col("id").alias("v"))
    small = small.unionByName(spark.range(40).select(F.col("id").alias("k"), F.lit(1).cast(small.schema["v"].dataType).alias("v")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = most_in_a_task(skew_join(large, small, ["k"], limit=0))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 11 * 40_000 + 440 and max(sizes) <= 2 * sum(sizes) / 4


@pytest.mark.parametrize("how", ["inner", "left"])
def test_columns_of_any_name_take_the_hot_way(spark, how):
    """Both sides bring columns with the names that helpers could have."""
    mine = ["_row", "pieces", "_piece", "rows", "_other", "a b", "a.b"]
    others = ["other_pieces", "_other_piece", "_work", "hot"]
    large = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).otherwise(F.col("id") % 30).cast("long").alias("k"), *[(F.col("id") + i).alias(n) for i, n in enumerate(mine)])
    small = spark.range(20).select(F.col("id").alias("k"), *[(F.col("id") * i).alias(n) for i, n in enumerate(others)])
    got = skew_join(large, small, ["k"], how, limit=0)
    assert got.columns == ["k", *mine, *others]
    assert sorted(got.collect(), key=str) == sorted(large.join(small, "k", how).collect(), key=str)
    renamed = large.withColumnRenamed("k", "rows2").withColumnRenamed("rows", "k").withColumnRenamed("rows2", "rows")
    got = skew_join(renamed, small.withColumnRenamed("k", "rows"), ["rows"], how, limit=0)
    assert sorted(got.collect(), key=str) == sorted(renamed.join(small.withColumnRenamed("k", "rows"), "rows", how).collect(), key=str)


def test_equal_rows_of_a_hot_key_part(spark):
    large = spark.range(40_000).select(F.lit(7).cast("long").alias("k"), F.lit("same").alias("v"))
    small = spark.range(10).select(F.col("id").alias("k"), F.lit("x").alias("w"))
    hot = hot_keys(count_keys(large, ["k"]), count_keys(small, ["k"]), ["k"]).first()
    assert hot.pieces >= 4
    sizes = most_in_a_task(skew_join(large, small, ["k"], limit=0))
    assert sum(sizes) == 40_000 and max(sizes) <= 20_000


def test_equal_rows_are_dealt_evenly(spark):
    dealt = deal_rows(spark.range(0, 1000, 1, 1).select(F.lit("copy").alias("text")))
    assert [row["count"] for row in dealt.groupBy(F.spark_partition_id()).count().collect()] == [250] * 4


def test_broadcast_limits(spark):
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 100).alias("t"))
    assert fits_broadcast(df)
    assert not fits_broadcast(df, rows=99)
    assert not fits_broadcast(df, size=5000)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_ids_follow_the_order(spark, partitions):
    df = spark.range(1000).select(F.expr("if(id % 3 = 0, null, id * 7919 % 500)").alias("k"), F.col("id").alias("v"))
    rows = assign_ids(df, ["k", "v"], partitions=partitions).orderBy("id").collect()
    assert [row["id"] for row in rows] == list(range(1000))
    assert [(row["k"], row["v"]) for row in rows] == sorted(((r["k"], r["v"]) for r in df.collect()), key=lambda r: (r[0] is not None, r))


def test_rows_alike_share_no_task(spark):
    """A hot value, here the only one, still goes to several partitions."""
    df = spark.range(4000, numPartitions=4).select(F.lit("same").alias("k"))
    numbered = assign_ids(df, ["k"], partitions=4)
    assert sorted(row["id"] for row in numbered.collect()) == list(range(4000))
    stored = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in numbered.inputFiles()})
    sizes = [row["count"] for row in stored.groupBy(F.shiftright("_place", 33)).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000


def test_first_and_last(spark):
    df = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 2, None), (1, 2, "b")], "id long, seq int, v string")
    assert sorted(tuple(r) for r in first_match(df, ["id"], ["seq"]).collect()) == [(1, 1, "a"), (2, 2, None)]
    assert sorted(tuple(r) for r in last_per_id(df, ["seq"]).collect()) == [(1, 3, "c"), (2, 2, None)]


@pytest.mark.parametrize("limit", [0, 1000])
def test_update(spark, limit):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z")], "id long, v string, w string")
    updates = spark.createDataFrame([(1, "old", 1), (1, "", 2), (3, None, 1), (9, "new", 1)], "id long, v string, seq int")
    got = update_by_id(target, updates, ["v"], order=["seq"], limit=limit).orderBy("id").collect()
    assert [tuple(row) for row in got] == [(1, "", "x"), (2, "b", "y"), (3, None, "z")]


def test_update_keeps_the_targets_types(spark):
    target = spark.createDataFrame([(1, "a")], "id long, v string")
    updates = spark.createDataFrame([(1, 2.5)], "id long, v double")
    assert update_by_id(target, updates, ["v"], ["v"]).collect()[0]["v"] == "2.5"
