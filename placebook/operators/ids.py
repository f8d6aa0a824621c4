"""Consecutive ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from placebook.operators.joins import shuffle_partitions
from placebook.session import materialize

ROW_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in this many low bits


def assign_ids(df: DataFrame, order: Sequence[str], name: str = "id", partitions: int | None = None) -> DataFrame:
    """Ids 0, 1, 2, ... in ascending order of the columns, nulls first.

    Rows are stored, as finding ranges looks at them twice; then range-partitioned, sorted within partitions and stored
    with their place. Each partition starts where the one before it ended; only one count per partition is brought
    together. Rows alike in all order columns may go to several partitions, so a hot value does not fill one task.
    """
    ascending = [F.asc_nulls_first(column) for column in order]
    tied = materialize(df, "unplaced").withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(partitions or shuffle_partitions(df), *ascending, F.asc("_tie"))
    placed = ranged.sortWithinPartitions(*ascending, F.asc("_tie")).drop("_tie").withColumn("_place", F.monotonically_increasing_id())
    stored = materialize(placed, "placed").withColumns(
        {"_part": F.shiftright("_place", ROW_BITS), "_row": F.col("_place").bitwiseAND((1 << ROW_BITS) - 1)}
    )
    counts = stored.groupBy("_part").agg((F.max("_row") + 1).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    # One row per partition: always small.
    return stored.join(F.broadcast(starts), "_part").select(
        (F.col("_start") + F.col("_row")).alias(name), *[F.col(column) for column in df.columns]
    )
