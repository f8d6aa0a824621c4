"""Nested answers turned into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from placebook.functions.text import file_name_from_url, first_filled

# The parts of a company answer and of a catalogue answer that are read.
COMPANY_ANSWER = "results array<string>"
COMPANY = "nom_complet string, siege struct<siret: string, adresse: string>"
CATALOGUE_ANSWER = "data array<struct<resources: array<struct<title: string, format: string, url: string>>>>"

# What the wanted resource has in its title, and its format.
TITLE_WORD = "stocketablissement"
FORMAT = "parquet"


def columns_to_rows(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Tables held as one array per column, turned into rows.

    A table has as many rows as `id` has elements, or as the first column if `id` is absent or empty. Shorter columns
    are filled with nulls, longer ones cut, and a column that is not an array is null.
    """
    arrays = [name for name in cols if isinstance(df.schema[name].dataType, T.ArrayType)]
    if not arrays:
        return df.select(*keep, F.lit(0).alias("position"), *cols).where(F.lit(False))

    def length(name: str) -> Column:
        return F.coalesce(F.size(name), F.lit(0)) if name in arrays else F.lit(0)

    rows = length(cols[0])
    if "id" in cols:
        rows = F.when(length("id") > 0, length("id")).otherwise(rows)
    filled = [F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType)).alias(name) for name in arrays]
    exploded = df.select(*keep, F.posexplode(F.slice(F.arrays_zip(*filled), F.lit(1), rows)).alias("position", "_r"))
    cells = [F.col("_r")[name] if name in arrays else F.lit(None).cast(df.schema[name].dataType) for name in cols]
    return exploded.select(*keep, "position", *[cell.alias(name) for cell, name in zip(cells, cols)])


def flatten_companies(df: DataFrame, column: str = "answer", keep: Sequence[str] = ()) -> DataFrame:
    """Company answers (JSON text) as results in the order of the answer; missing parts are ''. `origine` and `source` are
    the whole item as JSON text, parts that are not read included. For answers that are no JSON see unreadable_answers.
    """
    parsed = df.select(*keep, F.from_json(column, COMPANY_ANSWER).alias("_a"))
    items = parsed.select(*keep, F.posexplode("_a.results").alias("position", "origine")).withColumn("_c", F.from_json("origine", COMPANY))
    return items.select(
        *keep,
        "position",
        first_filled("_c.nom_complet").alias("nom"),
        first_filled("_c.siege.adresse").alias("adresse"),
        first_filled("_c.siege.siret").alias("siret"),
        F.lit(None).cast("double").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"),
        "origine",
        F.col("origine").alias("source"),
    )


def unreadable_answers(df: DataFrame, column: str = "answer") -> DataFrame:
    """The rows whose answer is text, but no JSON; none of the readers of answers gives results for them."""
    return df.where(F.col(column).isNotNull() & F.try_parse_json(column).isNull())


def pick_resource(df: DataFrame, title_word: str = TITLE_WORD, fmt: str = FORMAT, column: str = "answer", keep: Sequence[str] = ()) -> DataFrame:
    """From each catalogue answer (JSON text) the first fitting resource of its first dataset; no row if there is none.

    A resource fits if its title contains the word and its format, or the end of its address, is the wanted one.
    """

    def lowered(c: Column) -> Column:
        return F.lower(F.coalesce(c, F.lit("")))

    def fits(resource: Column) -> Column:
        right_format = (lowered(resource["format"]) == fmt) | lowered(resource["url"]).endswith(f".{fmt}")
        return lowered(resource["title"]).contains(title_word) & right_format

    resources = F.get(F.col("_a.data"), F.lit(0))["resources"]
    picked = df.select(*keep, F.from_json(column, CATALOGUE_ANSWER).alias("_a")).select(
        *keep, F.get(F.filter(resources, fits), F.lit(0)).alias("_r")
    )
    return picked.where(F.col("_r").isNotNull()).select(*keep, "_r.*", file_name_from_url("_r.url").alias("file_name"))
