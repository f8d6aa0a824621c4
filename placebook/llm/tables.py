"""Reading the given tables, and keys that stand for one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Sorts after every other id; stands for a missing one where ids are compared.
LAST_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_or_last(name: str = "doc_id") -> Column:
    """The id, a missing one as the last of all."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is. Spark's own lower() does just that where all characters are ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
