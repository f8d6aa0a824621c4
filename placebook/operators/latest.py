"""One row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from placebook.operators.joins import named, own_name


def first_match(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key. Rows are reduced before the shuffle, so the size of a group does not matter."""
    return _pick(df, keys, order, F.min_by)


def last_per_id(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ("id",)) -> DataFrame:
    """The last row of each key wins."""
    return _pick(df, keys, order, F.max_by)


def _pick(df, keys, order, pick):
    rest, row = [name for name in df.columns if name not in keys], own_name("row")
    picked = df.groupBy(*map(named, keys)).agg(pick(F.struct(*map(named, rest)), F.struct(*order)).alias(row))
    return picked.select(*[named(name) if name in keys else F.col(row)[name].alias(name) for name in df.columns])
