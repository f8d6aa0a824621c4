"""Points summarised for a map: clusters at every zoom level, bounds, markers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from placebook.functions.geo import TILE, cell_of, is_selected, pixel_x, pixel_y, size_class
from placebook.operators.joins import lookup, shuffle_partitions
from placebook.session import BROADCAST_ROWS, fits_broadcast, materialize

# Cluster radius in pixels, the zoom from which points stand alone, the closest zoom that bounds are fitted to.
RADIUS = 30
SINGLE_FROM = 18
FIT_ZOOM = 15

ZOOMS_PER_STEP = 6

KEYS = ["zoom", "cx", "cy"]
BOX = ["min_lat", "min_lng", "max_lat", "max_lng"]
RESULT = [*KEYS, "n", "lat", "lng", *BOX, "id", "size_class", "has_selected"]


def flag_selected(points: DataFrame, selected: int | DataFrame | None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Points with `selected`: is it the selected row, or one of a table of selected ids?"""
    if isinstance(selected, DataFrame):
        ids = selected.select("id").distinct().withColumn("selected", F.lit(True))
        flagged = lookup(points, ids, ["id"], fits=fits_broadcast(ids, limit))
        return flagged.withColumn("selected", F.coalesce("selected", F.lit(False)))
    return points.withColumn("selected", is_selected("id", selected))


def cluster_points(
    points: DataFrame,
    zooms: Sequence[int] = tuple(range(SINGLE_FROM)),
    radius: int = RADIUS,
    selected: int | DataFrame | None = None,
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Clusters of points (id, lng, lat) that share a cell of `radius` pixels, for each zoom level.

    `lat`, `lng` are the members' mean, `min_*` and `max_*` the area they cover, `id` is set for a single point.
    Points are shuffled once, for the finest level, whose sums each task adds up beforehand. A cell is made of four of
    the next level, so the other levels come from cells, a few at a time, the coarsest of a step being stored for the next.
    """
    flagged = flag_selected(points, selected, limit)
    grouped = sorted({zoom for zoom in zooms if zoom < SINGLE_FROM}, reverse=True)
    alone = sorted(set(zooms) - set(grouped))
    layers = [points_alone(flagged, alone)] if alone else []
    steps = [grouped[:1]] + [grouped[i : i + ZOOMS_PER_STEP] for i in range(1, len(grouped), ZOOMS_PER_STEP)] if grouped else []
    cells = None
    for step in steps:
        layer = _finest(flagged, step[0], radius) if cells is None else _coarser(cells, finer, step)
        if step is not steps[-1]:
            layer = materialize(layer, "cells")
        layers.append(layer)
        cells, finer = layer.where(F.col("zoom") == step[-1]), step[-1]
    return reduce(DataFrame.unionByName, [finish(layer) for layer in layers])


def _sums(n: Column, lat: Column, lng: Column, low: list[Column], high: list[Column], id_: Column, selected: Column) -> list[Column]:
    return [
        n.alias("n"),
        lat.alias("sum_lat"),
        lng.alias("sum_lng"),
        *[F.min(c).alias(name) for c, name in zip(low, BOX[:2])],
        *[F.max(c).alias(name) for c, name in zip(high, BOX[2:])],
        F.min(id_).alias("id"),
        F.bool_or(selected).alias("has_selected"),
    ]


def _finest(points: DataFrame, zoom: int, radius: int) -> DataFrame:
    lat, lng = F.col("lat"), F.col("lng")
    cells = points.select(
        F.lit(zoom).alias("zoom"),
        cell_of(pixel_x(lng, zoom), radius).alias("cx"),
        cell_of(pixel_y(lat, zoom), radius).alias("cy"),
        "id", "lat", "lng", "selected",
    )
    sums = _sums(F.count("*"), F.sum(lat), F.sum(lng), [lat, lng], [lat, lng], F.col("id"), F.col("selected"))
    return cells.groupBy(*KEYS).agg(*sums)


def _coarser(cells: DataFrame, finer: int, zooms: list[int]) -> DataFrame:
    """The given zoom levels from the cells of a finer one.

    The cells are dealt once by their cell at the coarsest of these levels, which holds few of the finer ones; all levels
    are then made where the cells are.
    """
    places = {f"_{name}": F.shiftright(name, finer - zooms[-1]) for name in ("cx", "cy")}
    dealt = cells.drop("zoom").withColumns(places).repartition(shuffle_partitions(cells), *places)
    repeated = dealt.withColumn("zoom", F.explode(F.array(*[F.lit(zoom) for zoom in zooms])))
    parents = repeated.withColumns({name: F.expr(f"shiftright({name}, {finer} - zoom)") for name in ("cx", "cy")})
    n, low, high = F.sum("n"), [F.col(name) for name in BOX[:2]], [F.col(name) for name in BOX[2:]]
    sums = _sums(n, F.sum("sum_lat"), F.sum("sum_lng"), low, high, F.col("id"), F.col("has_selected"))
    return parents.groupBy(*KEYS, *places).agg(*sums).drop(*places)


def points_alone(points: DataFrame, zooms: list[int]) -> DataFrame:
    """Each point is a cell of its own, named by its id."""
    return points.select(
        F.explode(F.array(*[F.lit(zoom) for zoom in zooms])).alias("zoom"),
        F.col("id").alias("cx"),
        F.lit(None).cast("bigint").alias("cy"),
        F.lit(1).cast("bigint").alias("n"),
        F.col("lat").alias("sum_lat"),
        F.col("lng").alias("sum_lng"),
        *[F.col(name[4:]).alias(name) for name in BOX],
        "id",
        F.col("selected").alias("has_selected"),
    )


def finish(cells: DataFrame) -> DataFrame:
    """Cells with sums as clusters."""
    return cells.withColumns(
        {
            "lat": F.col("sum_lat") / F.col("n"),
            "lng": F.col("sum_lng") / F.col("n"),
            "id": F.when(F.col("n") == 1, F.col("id")),
            "size_class": size_class("n"),
        }
    ).select(*RESULT)


def bounds(points: DataFrame) -> DataFrame:
    """One row: the box around all points, nulls if there are none."""
    return points.agg(
        F.min("lat").alias("min_lat"), F.min("lng").alias("min_lng"), F.max("lat").alias("max_lat"), F.max("lng").alias("max_lng")
    )


def fit_zoom(box: DataFrame, width: int, height: int, closest: int = FIT_ZOOM) -> DataFrame:
    """Boxes with the largest `zoom`, at most `closest`, at which they fit a viewport of that many pixels."""
    across = pixel_x(F.col("max_lng"), 0) - pixel_x(F.col("min_lng"), 0)
    down = pixel_y(F.col("min_lat"), 0) - pixel_y(F.col("max_lat"), 0)
    scale = F.least(
        F.when(across > 0, F.lit(width) / across).otherwise(F.lit(float(TILE << closest))),
        F.when(down > 0, F.lit(height) / down).otherwise(F.lit(float(TILE << closest))),
    )
    zoom = F.greatest(F.least(F.floor(F.log2(scale)), F.lit(closest)), F.lit(0)).cast("int")
    return box.withColumn("zoom", F.when(F.col("min_lat").isNotNull(), zoom))
