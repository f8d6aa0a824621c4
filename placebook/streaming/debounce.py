"""Keeping only the last input of a burst."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from placebook.operators.filters import filter_short_queries
from placebook.session import materialize

# The silence that ends a burst, the fewest characters worth a search.
SILENCE = "300 milliseconds"
LEAST = 3


def debounce(
    df: DataFrame, key: str, ts: str, text: str, gap: str = SILENCE, order: Sequence[str] = (), slice_length: str = "1 hour", least: int = LEAST
) -> DataFrame:
    """The last input of each burst of a table of inputs: key, ts, text. An input `gap` after the last starts a new burst.

    Time is cut into slices at least `gap` long, so that a busy key is spread over tasks. Within a slice the next input
    is the next row; the last row of a slice looks at the first input of the following slice.
    """
    silence = F.expr(f"interval '{gap}'")
    longer = df.sparkSession.sql(f"select greatest(interval '{gap}', interval '{slice_length}')").first()[0]
    length = longer // timedelta(microseconds=1)
    kept = [key, ts, text, *[name for name in order if name not in (key, ts, text)]]
    cut = df.select(*kept, F.window(ts, f"{length} microseconds").alias("_w"))
    sliced = cut.select(*kept, F.col("_w.start").alias("_slice"), F.col("_w.end").alias("_next_slice"))
    sliced = sliced.withColumn("_key", F.struct(key))  # in structs nulls are equal
    following = sliced.groupBy("_key", F.col("_slice").alias("_next_slice")).agg(F.min(ts).alias("_following"))

    def quiet_until(then: str) -> Column:
        return F.col(then).isNull() | (F.col(then) - F.col(ts) >= silence)

    in_slice = Window.partitionBy(key, "_slice").orderBy(ts, *order)
    ends = sliced.withColumn("_next", F.lead(ts).over(in_slice)).where(quiet_until("_next"))
    last = ends.join(following, ["_key", "_next_slice"], "left").where(F.col("_next").isNotNull() | quiet_until("_following"))
    return filter_short_queries(last.select(key, ts, text), text, least)


def debounce_stream(
    df: DataFrame, key: str, ts: str, text: str, delay: str, gap: str = SILENCE, order: Sequence[str] = (), least: int = LEAST
) -> DataFrame:
    """The same on a stream, as session windows: a burst comes out once the watermark has passed its end.

    `delay` is how late an input may come after later ones; what comes later still is dropped, and the progress of the
    query counts it (numRowsDroppedByWatermark). Bursts that are open when the input stops are given by `open_bursts`. With
    the session's spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition a busy key sends fewer rows.
    """
    timed = df.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    last = F.max_by(F.struct(ts, text), F.struct("_ts", *order)).alias("_last")
    bursts = timed.groupBy(key, F.session_window("_ts", gap)).agg(last)
    return filter_short_queries(bursts.select(key, f"_last.{ts}", f"_last.{text}"), text, least)


def open_bursts(
    inputs: DataFrame, written: DataFrame, key: str, ts: str, text: str, gap: str = SILENCE, order: Sequence[str] = (), least: int = LEAST
) -> DataFrame:
    """The bursts that a stream over `inputs`, now at its end, has left open: all that are not among the rows it wrote."""
    every = debounce(inputs, key, ts, text, gap, order, least=least)
    known = written.select(F.struct(key, ts).alias("_burst"))
    # As structs, in which nulls are equal.
    return every.withColumn("_burst", F.struct(key, ts)).join(known, "_burst", "left_anti").select(key, ts, text)


# --- bursts with a record of what came late -----------------------------------------------------------------------------


def debounce_batches(
    df: DataFrame, path: str, checkpoint: str, key: str, ts: str, text: str, delay: str, gap: str = SILENCE, order: Sequence[str] = (), least: int = LEAST,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Writes the last inputs of bursts, batch by batch, and keeps a record of what they were decided on.

    After each batch the watermark is the latest time seen so far less `delay`, never earlier than before; it is written to
    `watermarks`. A batch's inputs before the watermark of the batch before it, and those without a time, go to `late` and
    count for nothing. An input is the last of its burst if no other follows within `gap`, which is certain once the
    watermark has passed that time: it then goes to `bursts`. Inputs that are not certain yet wait in `open`; a key's are cut
    into slices of time, so that a busy key is spread over tasks, in the stream as in the batch form. So the bursts are
    those of all inputs that were not late, as far as the last watermark.

    Each batch writes folders of its own from those of the batch before; run again after a failure it replaces them. A
    checkpoint goes with one path.
    """
    kept = [key, ts, text, *[name for name in order if name not in (key, ts, text)]]
    rows = T.StructType([df.schema[name] for name in kept])
    silence, lateness = F.expr(f"interval '{gap}'"), F.expr(f"interval '{delay}'")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = materialize(batch.select(*kept), "inputs")
        before = read_watermarks(spark, path).where(F.col("batch") < number).agg(F.max_by("watermark", "batch"), F.max("batch")).first()
        mark = F.lit(before[0]).cast(rows[ts].dataType)
        # Nothing is late before the first watermark.
        late = F.col(ts).isNull() | F.coalesce(F.col(ts) < mark, F.lit(False))
        batch.where(late).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        waiting = spark.read.schema(rows).parquet(f"{path}/open/batch={before[1]}") if before[1] is not None else batch.limit(0)
        inputs = materialize(waiting.unionByName(batch.where(~late)), "inputs")
        passed = batch.agg(F.greatest(F.max(ts) - lateness, mark).alias("watermark"), F.count_if(late).alias("late"), F.count("*").alias("inputs"))
        passed = materialize(passed, "watermark")
        until = F.lit(passed.first()["watermark"]).cast(rows[ts].dataType)
        certain = F.coalesce(F.col(ts) + silence <= until, F.lit(False))
        debounce(inputs, key, ts, text, gap, order, least=least).where(certain).write.mode("overwrite").parquet(f"{path}/bursts/batch={number}")
        inputs.where(~certain).write.mode("overwrite").parquet(f"{path}/open/batch={number}")
        passed.write.mode("overwrite").parquet(f"{path}/watermarks/batch={number}")

    for part in ("late", "open", "bursts"):
        df.sparkSession.createDataFrame([], rows).write.mode("append").parquet(f"{path}/{part}/batch=-1")
    marks = T.StructType([T.StructField("watermark", rows[ts].dataType), T.StructField("late", T.LongType()), T.StructField("inputs", T.LongType())])
    df.sparkSession.createDataFrame([], marks).write.mode("append").parquet(f"{path}/watermarks/batch=-1")
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_watermarks(spark: SparkSession, path: str) -> DataFrame:
    """(batch, watermark, late, inputs) of each batch of `debounce_batches`."""
    return spark.read.parquet(f"{path}/watermarks").select("batch", "watermark", "late", "inputs")


def read_bursts(spark: SparkSession, path: str) -> DataFrame:
    """The last inputs of bursts that `debounce_batches` has written, with the `batch` that did."""
    return spark.read.parquet(f"{path}/bursts")


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """The inputs that came too late for `debounce_batches`, with their `batch`."""
    return spark.read.parquet(f"{path}/late")
