"""Filling coordinates as records change."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from placebook.operators.geocode import geocode, geocode_candidates, geocode_updates
from placebook.operators.latest import last_per_id
from placebook.operators.update import update_by_id
from placebook.session import materialize

AT_ONCE = {"availableNow": True}
ANSWER_ORDER = ["answered", "run", "batch"]


def geocode_batch(changes: DataFrame, gazetteer: DataFrame, order: Sequence[str]) -> DataFrame:
    """What to write back for a batch of changed records, of which the last per id counts, and the `address` looked up."""
    latest = last_per_id(changes, order)
    found = geocode(geocode_candidates(latest), gazetteer)
    return geocode_updates(found.withColumn("address", F.col("Address")), ["address"])


def geocode_stream(
    changes: DataFrame, gazetteer: DataFrame, answers: str, checkpoint: str, order: Sequence[str], trigger: Mapping[str, object] = AT_ONCE
) -> StreamingQuery:
    """Looks up changed records batch by batch; each batch's answers go to a folder of its own.

    `trigger` says when batches run: all that is there and no more by default, {"processingTime": "10 seconds"} for a
    standing query. A batch that is run again after a failure replaces its own folder; folders are named by checkpoint
    and batch, so another checkpoint overwrites nothing. The target is not rewritten for each batch: `with_answers` lays
    the answers over it, and its result can be stored now and then.
    """

    gazetteer = materialize(gazetteer, "gazetteer")
    run = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            found = geocode_batch(held, gazetteer, order).withColumn("answered", F.current_timestamp())
            found.write.mode("overwrite").parquet(f"{answers}/run={run}/batch={batch_id}")
        finally:
            held.unpersist()

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_answers(spark: SparkSession, answers: str) -> DataFrame:
    """All answers, with the `run` and `batch` that gave them and when (`answered`)."""
    return spark.read.parquet(answers).withColumns({"run": F.col("run").cast("string"), "batch": F.col("batch").cast("bigint")})


def last_answers(answers: DataFrame) -> DataFrame:
    """The last answer for each id and address."""
    return last_per_id(answers, ANSWER_ORDER, keys=("id", "address"))


def compact_answers(answers: DataFrame, path: str) -> DataFrame:
    """Writes the last answers to a folder of their own, which can take the place of all folders that were read."""
    last_answers(answers).write.parquet(path, partitionBy=["run", "batch"])
    return read_answers(answers.sparkSession, path)


def with_answers(target: DataFrame, answers: DataFrame) -> DataFrame:
    """The target table with answers laid over the rows that still need coordinates, and for the address they now have.

    A row whose coordinates were given by hand after the answer stays as it is.
    """
    columns = [name for name in answers.columns if name not in ("id", "address", "answered", "run", "batch")]
    needing = geocode_candidates(target).select("id", F.col("Address").alias("address")).distinct()
    return update_by_id(target, needing.join(last_answers(answers), ["id", "address"]), columns, order=ANSWER_ORDER)
