"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from placebook.functions.text import long_enough

# Postal code prefixes kept by default, the state of an open establishment,
# the distance in degrees from (0, 0) that marks a bad import.
PREFIXES = ("44", "85")
ACTIVE = "A"
NEAR_ZERO = 0.01


def has_prefix(column: str, prefixes: Sequence[str] = PREFIXES) -> Column:
    return reduce(or_, [F.col(column).startswith(prefix) for prefix in prefixes], F.lit(False))


def filter_prefix(df: DataFrame, column: str = "codePostalEtablissement", prefixes: Sequence[str] = PREFIXES) -> DataFrame:
    """Rows whose text starts with any of the prefixes."""
    return df.where(has_prefix(column, prefixes))


def filter_active(df: DataFrame, column: str = "etatAdministratifEtablissement") -> DataFrame:
    return df.where(F.col(column) == ACTIVE)


def filter_short_queries(df: DataFrame, column: str = "text", least: int = 3) -> DataFrame:
    """Drops typed texts too short to search for."""
    return df.where(long_enough(column, least))


def valid_points(df: DataFrame) -> DataFrame:
    """Rows (lng, lat as text or numbers) with a usable point, both coordinates as numbers.

    A cell still being geocoded holds `...`, which is no number either.
    """
    numbers = df.withColumns({name: F.col(name).try_cast("double") for name in ("lng", "lat")})
    lng, lat = F.col("lng"), F.col("lat")
    given = lng.isNotNull() & lat.isNotNull() & ~F.isnan(lng) & ~F.isnan(lat)
    return numbers.where(given & (F.greatest(F.abs(lng), F.abs(lat)) >= NEAR_ZERO))


def select_records(df: DataFrame, chosen: int | DataFrame) -> DataFrame:
    """Only the chosen record, or those whose id occurs in a table of chosen ids."""
    if isinstance(chosen, DataFrame):
        return df.join(chosen.select("id").distinct(), "id", "left_semi")
    return df.where(F.col("id") == chosen)
