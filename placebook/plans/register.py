"""From a register snapshot to the search-ready register."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from placebook.functions.text import first_filled, join_filled, search_text
from placebook.operators.columns import project_register
from placebook.operators.filters import PREFIXES, filter_active, filter_prefix
from placebook.operators.ids import assign_ids
from placebook.sinks.register import count_rows, write_register

# The columns of the search-ready register.
SEARCH_READY = ["id", "siret", "siren", "nom", "adresse", "code_postal", "commune", "ape", "search"]


def describe(register: DataFrame) -> DataFrame:
    """Search-ready columns of register rows, without ids and search texts."""
    return register.select(
        "siret",
        "siren",
        first_filled("enseigne1Etablissement", "denominationUniteLegale").alias("nom"),
        join_filled("numeroVoieEtablissement", "typeVoieEtablissement", "libelleVoieEtablissement").alias("adresse"),
        F.col("codePostalEtablissement").alias("code_postal"),
        first_filled("libelleCommuneEtablissement").alias("commune"),
        F.col("activitePrincipaleEtablissement").alias("ape"),
    )


def select_register(register: DataFrame, prefixes: Sequence[str] = PREFIXES) -> DataFrame:
    """Open establishments of the wanted departments. Both filters reach the Parquet scan."""
    return project_register(filter_active(filter_prefix(register, prefixes=prefixes)))


def number(described: DataFrame) -> DataFrame:
    """Ids by ascending siret; the other columns decide between rows without one. Search texts are made of the numbered
    rows, which are dealt to many tasks however few files the register has.
    """
    numbered = assign_ids(described, ["siret", *[name for name in described.columns if name != "siret"]])
    return numbered.withColumn("search", search_text("nom", "adresse", "commune"))


def build_register(register: DataFrame, prefixes: Sequence[str] = PREFIXES) -> DataFrame:
    """The search-ready register, numbered by ascending siret."""
    return number(describe(select_register(register, prefixes)))


def export_register(register: DataFrame, path: str, prefixes: Sequence[str] = PREFIXES) -> dict[str, int]:
    """Builds and writes the register; returns the rows read, kept after the prefix filter and exported.

    Counting the rows read means reading them all; use `build_register` and `write_register` where the scan should
    skip what the filters exclude.
    """
    read, rows_read = count_rows(register, "read")
    kept, rows_kept = count_rows(filter_prefix(read, prefixes=prefixes), "kept")
    exported, rows_exported = count_rows(number(describe(project_register(filter_active(kept)))), "exported")
    write_register(exported, path)
    return {name: observation.get["rows"] for name, observation in (("read", rows_read), ("kept", rows_kept), ("exported", rows_exported))}
