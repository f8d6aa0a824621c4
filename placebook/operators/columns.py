"""Choosing, naming and shaping columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from placebook.functions.cells import is_filled, parse_diff_cell
from placebook.functions.text import first_filled, normalize_query

# The register columns that are kept.
REGISTER_COLUMNS = [
    "siret", "siren", "nic",
    "denominationUniteLegale", "enseigne1Etablissement",
    "numeroVoieEtablissement", "typeVoieEtablissement", "libelleVoieEtablissement",
    "codePostalEtablissement", "libelleCommuneEtablissement",
    "activitePrincipaleEtablissement", "etatAdministratifEtablissement",
]

# The columns of a map table.
MAP_REQUIRED = ["Name", "Longitude", "Latitude"]
MAP_OPTIONAL = ["Geocode", "Address", "GeocodedAddress"]


class MissingColumns(ValueError):
    """A table lacks columns that are required of it."""


def check_columns(df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """The required and those optional columns that exist; complains if a required one does not."""
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise MissingColumns(f"columns missing: {', '.join(missing)}")
    return df.select(*required, *[name for name in optional if name in df.columns])


def project_register(df: DataFrame) -> DataFrame:
    return check_columns(df, REGISTER_COLUMNS)


def default_mapping(df: DataFrame, required: Sequence[str] = MAP_REQUIRED, optional: Sequence[str] = MAP_OPTIONAL) -> dict[str, str | None]:
    """Without a mapping every column goes by its own name; optional ones only where present."""
    return {name: name for name in required} | {name: name if name in df.columns else None for name in optional}


def rename_columns(df: DataFrame, mapping: Mapping[str, str | None]) -> DataFrame:
    """Mapped columns in place under their logical names, the others as they are, but for those that such a name hides.

    All names are read from the table as given: they may be chained or swapped, and one column may have several names.
    """
    given = {logical: actual for logical, actual in mapping.items() if actual in df.columns}
    kept = {name: [logical for logical, actual in given.items() if actual == name] for name in df.columns}
    unmapped = {name for name, names in kept.items() if not names and name not in given}
    return df.select(*[F.col(f"`{name}`").alias(new) for name, names in kept.items() for new in names or [name] * (name in unmapped)])


def mapped_value(df: DataFrame, mapping: Mapping[str, str | None], logical: str) -> Column:
    """The mapped column, else the column of the logical name, else ''; nothing, 0 and false count as missing."""
    names = [name for name in dict.fromkeys([mapping.get(logical), logical]) if name and name in df.columns]
    return first_filled(*[F.when(is_filled(name, df.schema[name].dataType), F.col(name).cast("string")) for name in names])


def map_columns(df: DataFrame, mapping: Mapping[str, str | None], keep: Sequence[str] = ("id",)) -> DataFrame:
    """One text column per logical name, after the columns to keep."""
    return df.select(*keep, *[mapped_value(df, mapping, logical).alias(logical) for logical in mapping])


def unified_result(df: DataFrame, nom: Column, adresse: Column, siret: Column | None = None) -> Column:
    """The record that results of every origin share; the raw row goes along."""
    raw = F.struct(*[F.col(f"`{name}`") for name in df.columns])
    return F.struct(
        F.coalesce(nom, F.lit("")).alias("nom"),
        F.coalesce(adresse, F.lit("")).alias("adresse"),
        F.coalesce(siret if siret is not None else F.lit(""), F.lit("")).alias("siret"),
        F.lit(None).cast("double").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"),
        raw.alias("origine"),
        raw.alias("source"),
    )


def prepare_searchable(df: DataFrame, mapping: Mapping[str, str | None] | None = None) -> DataFrame:
    """Each row as a result, with its name and address normalised for searching."""
    mapping = mapping or {}
    values = [mapped_value(df, mapping, logical) for logical in ("Nom", "Adresse", "SIRET")]
    return df.select(F.col("id"), unified_result(df, *values).alias("result")).withColumns(
        {
            "searchable_nom": normalize_query("result.nom"),
            "searchable_adresse": normalize_query("result.adresse"),
        }
    )


def map_info(df: DataFrame) -> DataFrame:
    """What the map needs of a row: id, name, lng, lat. Diff cells are resolved; only text columns can hold them."""
    check_columns(df, ["id", *MAP_REQUIRED])
    names = {"Name": "name", "Longitude": "lng", "Latitude": "lat"}
    text = {name for name, type_ in df.dtypes if type_ == "string"}
    return df.select("id", *[(parse_diff_cell(name) if name in text else F.col(name)).alias(short) for name, short in names.items()])
