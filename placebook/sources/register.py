"""Register snapshots and tables."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from placebook.operators.columns import MissingColumns, project_register


# What Spark's reader trims off a line to see whether it is filled; with line breaks in cells it skips empty lines only.
BLANKS = "".join(map(chr, range(33)))


def csv_headers(spark: SparkSession, path: str, multi_line: bool = False) -> dict[tuple[str, ...], list[str]]:
    """The files of a folder by the names in their first filled lines. Only lines up to these are read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    start = jvm.org.apache.hadoop.fs.Path(path)
    system = start.getFileSystem(conf)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    found: dict[tuple[str, ...], list[str]] = {}
    for match in system.globStatus(start) or []:
        files = system.listFiles(match.getPath(), True)
        while files.hasNext():
            file = files.next().getPath()
            if file.getName().startswith(("_", ".")):
                continue
            codec, stream = codecs.getCodec(file), system.open(file)
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
            line = reader.readLine()
            while line is not None and not line.removeprefix("\ufeff").strip("" if multi_line else BLANKS):
                line = reader.readLine()
            reader.close()
            if line is not None:  # else it has no rows either
                names = tuple(next(csv.reader([line.removeprefix("\ufeff")])))
                found.setdefault(names, []).append(file.toString())
    return found


def _read_csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", multi_line)
    reader = reader.option("nullValue", None).option("emptyValue", "")
    parts = []
    for names, files in sorted(csv_headers(spark, path, multi_line).items()):
        schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
        try:
            parts.append(project_register(reader.schema(schema).csv(files)))
        except MissingColumns as problem:
            raise MissingColumns(f"{files[0]}: {problem}") from None
    if not parts:
        raise FileNotFoundError(f"no CSV file with a header in {path}")
    return reduce(DataFrame.unionByName, parts)


def read_register(spark: SparkSession, path: str, fmt: str = "parquet", multi_line: bool = False) -> DataFrame:
    """A register snapshot, CSV with a header or Parquet, every column kept as text.

    Types are never guessed: a postal code 04400 read as a number would lose its zero. A CSV cell that does not fit
    is null. Columns go by the names in each file, which may differ in order, and only those needed are read. With
    `multi_line` cells may contain line breaks; a file is then read by one task.
    """
    if fmt == "csv":
        return _read_csv(spark, path, multi_line)
    if fmt == "parquet":
        kept = project_register(spark.read.parquet(path))
        # Text columns are left alone: a cast would keep filters from the Parquet scan.
        return kept.select(*[name if type_ == "string" else F.col(name).cast("string").alias(name) for name, type_ in kept.dtypes])
    raise ValueError(f"unknown format {fmt!r}; known are csv and parquet")


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalogue table or view in full."""
    return spark.table(name)


def read_changes(spark: SparkSession, path: str, schema, fmt: str = "parquet", glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Changed records as a stream: every file that appears in the folder."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)
