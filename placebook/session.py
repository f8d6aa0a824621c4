"""Where intermediate tables go, and how large a side may be to be broadcast."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Most a broadcast side may hold, counted before every broadcast this library asks for.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20

# A session's setting that names the folder where Spark has none.
FOLDER = "placebook.folder"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`, or else in the session's `placebook.folder`; all executors reach it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(FOLDER, None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, purpose: str) -> str:
    return f"{shared_folder(spark)}/placebook/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, safe from lost executors, its size known to Spark."""
    folder = new_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether the table is within both limits, by one pass of which only two sums leave the tasks."""
    widths = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            widths.append(F.coalesce(F.octet_length(column), F.lit(0)))
        elif isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            widths.append(F.coalesce(F.octet_length(F.to_json(F.struct(column))) * 4, F.lit(0)))
        else:
            widths.append(F.lit(8))
    total = sum(widths, F.lit(0)).cast("long")
    found = df.agg(F.count("*"), F.sum(total)).first()
    return found[0] <= rows and (found[1] or 0) <= size
