"""A map table turned into what a map shows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from placebook.functions.geo import marker_layer
from placebook.functions.text import label_text
from placebook.operators.columns import MAP_OPTIONAL, MAP_REQUIRED, check_columns, default_mapping, map_info, rename_columns
from placebook.operators.filters import valid_points
from placebook.operators.latest import last_per_id


def map_points(table: DataFrame, mapping: Mapping[str, str | None] | None = None, order: list[str] | None = None) -> DataFrame:
    """Usable points (id, name, lng, lat) of a table; with `order` only the last row of each id."""
    renamed = rename_columns(table, default_mapping(table) | dict(mapping or {}))
    checked = check_columns(renamed, ["id", *MAP_REQUIRED, *(order or [])], MAP_OPTIONAL)
    if order:
        checked = last_per_id(checked, order)
    return valid_points(map_info(checked))


def markers(points: DataFrame, selected: int | None = None) -> DataFrame:
    """One marker per point, with the text of its label and the layer it is drawn on."""
    return points.select("id", "lng", "lat", label_text("name").alias("label"), marker_layer("id", selected).alias("layer"))
