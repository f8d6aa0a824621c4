"""Joins in which one key may hold much of the larger side."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from placebook.session import BROADCAST_ROWS, fits_broadcast, materialize


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def deal_rows(df: DataFrame) -> DataFrame:
    """The rows, as many in each shuffle partition. For work on each of many short rows: a scan makes tasks by the bytes of
    its files and by their row groups, so a small file of millions of rows is one task.
    """
    return df.repartition(shuffle_partitions(df))


def own_name(purpose: str) -> str:
    """A column name that no table of a caller has."""
    return f"_{purpose}_{uuid.uuid4().hex}"


def named(name: str) -> Column:
    """The column of just this name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def count_keys(df: DataFrame, on: Sequence[str], name: str = "rows") -> DataFrame:
    return df.groupBy(*map(named, on)).agg(F.count("*").alias(name))


def hot_keys(counts: DataFrame, others: DataFrame, on: Sequence[str], both: bool = True, names: Sequence[str] = ("rows", "pieces", "other_pieces")) -> DataFrame:
    """From the rows per key of both sides: the keys that bring more work than an average shuffle partition, and over
    how many pieces to spread each side's rows. Work is the rows read and made. With `both` the larger side of a key is
    cut the finer, else only the first side is cut. At most as many keys as there are shuffle partitions. `names` are the
    columns of the counts and of the pieces.
    """
    counted, pieces, other_pieces = names
    other_name, work = own_name("other"), own_name("work")
    rows, other = F.col(counted), F.col(other_name)
    met = counts.join(others.withColumnRenamed(counted, other_name), list(on), "left").withColumn(other_name, F.coalesce(other_name, F.lit(0)))
    met = materialize(met.withColumn(work, (rows + other + rows * other).cast("double")), "key-counts")
    share = F.col(work) * shuffle_partitions(counts) / met.agg(F.sum(work)).scalar()
    most = F.when(other > 0, F.sqrt(F.ceil(share) * rows / other)).otherwise(F.ceil(share)) if both else F.ceil(share)
    cut = met.where(share > 1).withColumn(pieces, F.least(rows, F.ceil(F.greatest(F.lit(1.0), most))).cast("int"))
    others_cut = F.least(F.greatest(other, F.lit(1)), F.ceil(share / F.col(pieces))) if both else F.lit(1)
    return cut.select(*map(named, on), pieces, others_cut.cast("int").alias(other_pieces))


def skew_join(
    large: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    limit: int = BROADCAST_ROWS,
    fits: bool | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """`large.join(small, on, how)`, inner or left.

    A small side within the size limits is broadcast; `fits` says so where the caller has measured it, else it is
    measured here. Beyond the limits both sides are shuffled. The rows of keys that bring too much work for one task are
    stored and numbered, each side's are dealt to pieces by their number, so that also equal rows part, and each piece of
    the one side meets each piece of the other. In a left join only the large side is cut. `counts` are the large side's
    `rows` per key, if known.
    """
    on = list(on)
    if fits_broadcast(small, rows=limit) if fits is None else fits:
        return large.join(F.broadcast(small), on, how)
    rows, row, pieces, other_pieces, piece, other_piece = map(own_name, ("rows", "row", "pieces", "other_pieces", "piece", "other_piece"))
    given = reduce(and_, [named(name).isNotNull() for name in on])
    counts = count_keys(large, on, rows) if counts is None else counts.withColumnRenamed("rows", rows)
    hot = materialize(hot_keys(counts.where(given), count_keys(small, on, rows), on, how == "inner", (rows, pieces, other_pieces)), "hot")
    keyed = large.where(given)
    if hot.limit(1).count() == 0:
        joined = keyed.join(small, on, how)
    else:
        few, keys = F.broadcast(hot), F.broadcast(hot.select(*map(named, on)))
        cool = keyed.join(keys, on, "left_anti").join(small, on, how)
        place = F.monotonically_increasing_id()
        left = materialize(keyed.join(keys, on, "left_semi"), "hot-rows").withColumn(row, place).join(few, on)
        right = materialize(small.join(keys, on, "left_semi"), "hot-rows").withColumn(row, place).join(few, on)
        dealt = lambda n: F.pmod(F.col(row), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = [row, pieces, other_pieces]
        left = left.withColumn(piece, dealt(pieces)).withColumn(other_piece, every(other_pieces)).drop(*own)
        right = right.withColumn(other_piece, dealt(other_pieces)).withColumn(piece, every(pieces)).drop(*own)
        hot_joined = left.join(right, [*on, piece, other_piece], how).drop(piece, other_piece)
        joined = cool.union(hot_joined)
    if how == "left":
        missing = [F.lit(None).cast(field.dataType).alias(field.name) for field in small.schema.fields if field.name not in on]
        rest = [named(name) for name in large.columns if name not in on]
        joined = joined.union(large.where(~given).select(*map(named, on), *rest, *missing))
    return joined


def lookup(large: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", limit: int = BROADCAST_ROWS, fits: bool | None = None) -> DataFrame:
    """A join on ids, of which no side has many alike: broadcast within the limits, else an ordinary shuffled join."""
    if fits_broadcast(small, rows=limit) if fits is None else fits:
        small = F.broadcast(small)
    return large.join(small, list(on), how)
