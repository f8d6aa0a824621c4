"""Export of the search-ready register and the counts of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F


def write_register(df: DataFrame, path: str, fmt: str = "json") -> None:
    """One JSON object per line (or any other format Spark writes), accents kept as they are, null cells as null."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.option("ignoreNullFields", False) if fmt == "json" else writer).save(path)


def count_rows(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that knows their number (`rows`) once an action has run."""
    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation
