"""Search a user table or register and write the choice into the rows searched for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from placebook.operators.columns import mapped_value, prepare_searchable
from placebook.operators.joins import lookup, skew_join
from placebook.operators.search import BEST, THRESHOLD, WEIGHTS, SearchIndex, fuzzy_search
from placebook.operators.update import update_by_id
from placebook.session import fits_broadcast, materialize

# The columns a chosen result is written to.
WRITTEN = {"SIRET": "siret", "RaisonSociale": "nom", "AdresseNormalisee": "adresse"}


def searchable_records(table: DataFrame, mapping: Mapping[str, str | None] | None = None) -> DataFrame:
    """The names and addresses of a user table, as an index is built of."""
    mapping = mapping or {}
    return table.select("id", mapped_value(table, mapping, "Nom").alias("nom"), mapped_value(table, mapping, "Adresse").alias("adresse"))


def search_table(
    queries: DataFrame,
    table: DataFrame,
    mapping: Mapping[str, str | None] | None = None,
    k: int = BEST,
    threshold: float = THRESHOLD,
    weights: Mapping[str, float] = WEIGHTS,
    index: SearchIndex | None = None,
) -> DataFrame:
    """The best `k` results in a user table for each query (qid, text): qid, rank, score, id, result. `index` is one of
    `searchable_records` of the same table, where it is searched more than once.
    """
    records = searchable_records(table, mapping) if index is None else index
    found = materialize(fuzzy_search(queries, records, k, threshold, weights), "found")
    results = prepare_searchable(table, mapping).select("id", "result")
    few = fits_broadcast(found)
    joined = lookup(results, found, ["id"], "inner", fits=True) if few else skew_join(found, results, ["id"])
    return joined.select("qid", "rank", "score", "id", "result")


def apply_choices(target: DataFrame, choices: DataFrame, order: Sequence[str], mapping: Mapping[str, str | None] | None = None) -> DataFrame:
    """The target with each chosen result (id of the target row, result) written into its three mapped columns. Of several
    choices for a row the last by `order` counts.
    """
    written = {(mapping or {}).get(logical) or logical: field for logical, field in WRITTEN.items()}
    updates = choices.select("id", *[F.col(f"result.{field}").alias(column) for column, field in written.items()], F.struct(*order).alias("_order"))
    return update_by_id(target, updates, list(written), ["_order"])


def write_best(target: DataFrame, found: DataFrame, mapping: Mapping[str, str | None] | None = None) -> DataFrame:
    """Takes each row's best result as chosen; `qid` is the id of the row that was searched for. Where a qid was searched
    for with several texts, the lowest score counts, and of equal ones the smallest id.
    """
    best = found.where(F.col("rank") == 1).select(F.col("qid").alias("id"), "result", (-F.col("score")).alias("_better"), (-F.col("id")).alias("_earlier"))
    return apply_choices(target, best, ["_better", "_earlier"], mapping)
