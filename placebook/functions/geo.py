"""Spherical Mercator pixels and what is derived from a point."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from placebook.functions.text import col

# Tile size in pixels, the latitude where the square world map ends,
# the member counts at which a cluster becomes medium and large.
TILE = 256
MAX_LATITUDE = 85.0511
MEDIUM, LARGE = 10, 100


def pixel_x(lng: Column, zoom: Column | int) -> Column:
    return F.lit(TILE) * F.pow(F.lit(2.0), F.lit(zoom)) * (lng + 180) / 360


def pixel_y(lat: Column, zoom: Column | int) -> Column:
    clipped = F.greatest(F.least(lat, F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE))
    sine = F.sin(F.radians(clipped))
    return F.lit(TILE) * F.pow(F.lit(2.0), F.lit(zoom)) * (0.5 - F.ln((1 + sine) / (1 - sine)) / (4 * F.pi()))


def cell_of(pixel: Column, width: int) -> Column:
    """Number of the cell of `width` pixels that a pixel lies in."""
    return F.floor(pixel / width)


def size_class(members: Column | str) -> Column:
    n = col(members)
    return F.when(n < MEDIUM, "small").when(n < LARGE, "medium").otherwise("large")


def is_selected(id_: Column | str, selected: int | None) -> Column:
    return F.lit(False) if selected is None else F.coalesce(col(id_) == F.lit(selected), F.lit(False))


def marker_layer(id_: Column | str, selected: int | None) -> Column:
    """The selected row's marker has a layer of its own."""
    return F.when(is_selected(id_, selected), "selectedMarker").otherwise("otherMarkers")
