"""Clusters of all zoom levels that are kept up to date as points come, move and go.

Two versioned tables hold the points and their cells. A change takes a point out of the cell it was in and puts it into the
cell it is in now: signed counts and sums (as decimals, so that nothing is lost by adding and taking away), rolled up from
the finest level to all others at once. A cell's box and its smallest id cannot be taken back like that; they are made
anew only for cells that lost a point at an edge of their box or the one with that id: at the finest level from the cell's
points, a few levels further from cells that are known by then.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placebook.functions.geo import cell_of, pixel_x, pixel_y
from placebook.operators.clusters import BOX, KEYS, RADIUS, RESULT, SINGLE_FROM, ZOOMS_PER_STEP, finish, points_alone
from placebook.operators.joins import lookup
from placebook.operators.latest import last_per_id
from placebook.session import fits_broadcast, materialize
from placebook.sinks.versions import VersionedTable

SUM = "decimal(33,15)"
ADDED = ["n", "sum_lat", "sum_lng", "n_selected"]
# What each edge of a cell is the least or greatest of.
EDGES = {"min_lat": (F.min, "lat"), "min_lng": (F.min, "lng"), "max_lat": (F.max, "lat"), "max_lng": (F.max, "lng"), "id": (F.min, "id")}
POINT = ["id", "lat", "lng", "selected"]

# Changes up to so many are known to be few in all that is made of them (at most 12 rows of 30 numbers for each), so that
# none of it is measured again before it is broadcast.
FEW = 10_000


def _sums(sign: Column | int = 1) -> list[Column]:
    sign = F.lit(sign) if isinstance(sign, int) else sign
    exact = lambda name: (F.col(name).cast("decimal(18,15)") * sign).cast("decimal(19,15)")
    return [
        F.sum(sign.cast("long")).alias("n"),
        F.sum(exact("lat")).cast(SUM).alias("sum_lat"),
        F.sum(exact("lng")).cast(SUM).alias("sum_lng"),
        F.sum(sign.cast("long") * F.col("selected").cast("int")).alias("n_selected"),
    ]


def _up(names: Sequence[str] = ("cx", "cy"), by: str = "by") -> dict[str, Column]:
    return {name: F.expr(f"shiftright({name}, {by})") for name in names}


class Pyramid:
    """`create` starts one, `Pyramid(spark, path)` opens it, `apply` brings in changes, `read` gives the clusters. One
    writer at a time; readers are never disturbed.
    """

    def __init__(self, spark: SparkSession, path: str, radius: int = RADIUS):
        self.spark, self.radius = spark, radius
        self.points, self.cells = VersionedTable(spark, f"{path}/points"), VersionedTable(spark, f"{path}/cells")

    @classmethod
    def create(cls, points: DataFrame, path: str, radius: int = RADIUS) -> Pyramid:
        """From points (id, lat, lng, selected) with unique ids and numbers for coordinates."""
        known = points.select("id", "lat", "lng", F.coalesce("selected", F.lit(False)).alias("selected"))
        VersionedTable.create(known, f"{path}/points", ["id"])
        new = cls(points.sparkSession, path, radius)
        finest = new._placed(new.points.read()).groupBy("cx", "cy").agg(*_sums(), *[f(name).alias(edge) for edge, (f, name) in EDGES.items()])
        cells = materialize(finest.withColumn("zoom", F.lit(SINGLE_FROM - 1)), "cells")
        layers = [cells]
        for source, zooms in new._steps():
            layer = new._spread(cells, source, zooms).groupBy(*KEYS).agg(*[F.sum(c).cast(dict(cells.dtypes)[c]).alias(c) for c in ADDED], *[f(edge).alias(edge) for edge, (f, _) in EDGES.items()])
            layers.append(materialize(layer, "cells"))
            cells = layers[-1].where(F.col("zoom") == zooms[-1])
        VersionedTable.create(reduce(DataFrame.unionByName, layers), f"{path}/cells", KEYS)
        return cls(points.sparkSession, path, radius)

    def _steps(self) -> list[tuple[int, list[int]]]:
        """A level and the coarser ones that are made of it, down to 0."""
        zooms = list(range(SINGLE_FROM - 2, -1, -1))
        steps = [zooms[i : i + ZOOMS_PER_STEP] for i in range(0, len(zooms), ZOOMS_PER_STEP)]
        return [(step[0] + 1, step) for step in steps]

    def _placed(self, points: DataFrame) -> DataFrame:
        zoom = SINGLE_FROM - 1
        return points.withColumns({"cx": cell_of(pixel_x(F.col("lng"), zoom), self.radius), "cy": cell_of(pixel_y(F.col("lat"), zoom), self.radius)})

    def _spread(self, cells: DataFrame, source: int, zooms: Sequence[int]) -> DataFrame:
        """Cells of a level under the cells of coarser levels that they are in."""
        spread = cells.drop("zoom").withColumn("zoom", F.explode(F.array(*map(F.lit, zooms)))).withColumn("by", F.lit(source) - F.col("zoom"))
        return spread.withColumns(_up()).drop("by")

    def read(self, zooms: Sequence[int] = tuple(range(SINGLE_FROM + 1)), version: int | None = None) -> DataFrame:
        """The clusters as `cluster_points` gives them; of a version only levels at which points do not stand alone."""
        grouped, alone = [z for z in zooms if z < SINGLE_FROM], [z for z in zooms if z >= SINGLE_FROM]
        if alone and version is not None:
            raise ValueError("points that stand alone are read as they are now")
        cells = self.cells.read(version).where(F.col("zoom").isin(grouped) & (F.col("n") > 0)).withColumn("has_selected", F.col("n_selected") > 0)
        layers = [finish(cells.withColumns({name: F.col(name).cast("double") for name in ("sum_lat", "sum_lng")})).select(*RESULT)]
        if alone:
            layers.append(finish(points_alone(self.points.read(), alone)))
        return reduce(DataFrame.unionByName, layers)

    def apply(self, changes: DataFrame, order: Sequence[str], batch: tuple[str, int] | None = None) -> int:
        """Brings in changed points (id, lat, lng, selected), the last of an id by `order`; one without coordinates goes, one
        that is new comes. Rows without an id are none. A batch (writer, number) that was brought in before has no effect,
        also if it was cut short in between. Returns the version of the cells.
        """
        last = last_per_id(changes.where(F.col("id").isNotNull()).select(*POINT, *[name for name in order if name not in POINT]), order)
        last = materialize(last.select("id", "lat", "lng", F.coalesce("selected", F.lit(False)).alias("selected")), "changes")
        placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
        if batch is None or self.cells.version().batches.get(batch[0], -1) < batch[1]:
            changed = self._changed_cells(last, last.where(placed))
            number = self.cells.put(changed, ["n"], batch)
        else:
            number = self.cells.version().number
        # Points follow the cells: a batch that was cut short here finds its cells done and brings in its points only.
        name = lambda what: None if batch is None else (f"{batch[0]}/{what}", batch[1])
        self.points.put(last.where(placed), ["id"], name("put"))
        self.points.drop(last.where(~placed).select("id"), name("drop"))
        return number

    def _changed_cells(self, last: DataFrame, new: DataFrame) -> DataFrame:
        now, cells = self.points.read(), self.cells.read()
        fits = True if fits_broadcast(last, FEW) else None
        old = materialize(lookup(now, last.select("id"), ["id"], "left_semi", fits=fits), "old-points")
        same = old.select(F.struct(*POINT).alias("p")).join(new.select(F.struct(*POINT).alias("p")), "p").select("p.id")
        went, came = (side.join(same, "id", "left_anti") for side in (old, new))
        signed = self._placed(went.withColumn("sign", F.lit(-1)).unionByName(came.withColumn("sign", F.lit(1))))
        edges = [c for edge, (f, name) in EDGES.items() for c in (f(F.when(F.col("sign") < 0, F.col(name))).alias(f"gone_{edge}"), f(F.when(F.col("sign") > 0, F.col(name))).alias(f"new_{edge}"))]
        deltas = materialize(signed.groupBy("cx", "cy").agg(*_sums(F.col("sign")), *edges).withColumn("zoom", F.lit(SINGLE_FROM - 1)), "cell-changes")

        left = lookup(now, last.select("id"), ["id"], "left_anti", fits=fits).unionByName(new.select(*POINT))

        def of_points(lost: DataFrame) -> DataFrame:
            inside = lookup(self._placed(left), lost.select("cx", "cy"), ["cx", "cy"], "left_semi", fits=fits)
            return inside.withColumn("zoom", F.lit(SINGLE_FROM - 1)).groupBy(*KEYS).agg(*[f(name).alias(edge) for edge, (f, name) in EDGES.items()])

        layers = [self._level(cells.where(F.col("zoom") == SINGLE_FROM - 1), deltas, of_points, fits)]
        for source, zooms in self._steps():
            known, done = cells.where(F.col("zoom") == source), layers[-1].where(F.col("zoom") == source)

            def of_cells(lost: DataFrame, source=source, zooms=zooms, known=known, done=done) -> DataFrame:
                """The edges of coarser cells, from the cells of a finer level as they are now."""
                roots = lost.select(*[F.expr(f"shiftright({c}, zoom - {zooms[-1]})").alias(f"_{c}") for c in ("cx", "cy")]).distinct()
                root = {f"_{c}": F.shiftright(c, source - zooms[-1]) for c in ("cx", "cy")}
                around = [lookup(side.withColumns(root), roots, list(root), "left_semi", fits=fits).drop(*root) for side in (known, done)]
                fresh = around[0].join(around[1].select("cx", "cy"), ["cx", "cy"], "left_anti").unionByName(around[1]).where("n > 0")
                inside = lookup(self._spread(fresh, source, zooms), lost.select(*KEYS), KEYS, "left_semi", fits=fits)
                return inside.groupBy(*KEYS).agg(*[f(edge).alias(edge) for edge, (f, _) in EDGES.items()])

            rolled = self._spread(deltas, SINGLE_FROM - 1, zooms).groupBy(*KEYS)
            merged = [f(f"{side}_{edge}").alias(f"{side}_{edge}") for edge, (f, _) in EDGES.items() for side in ("gone", "new")]
            rolled = rolled.agg(*[F.sum(c).cast(dict(deltas.dtypes)[c]).alias(c) for c in ADDED], *merged)
            layers.append(self._level(cells.where(F.col("zoom").isin(zooms)), materialize(rolled, "cell-changes"), of_cells, fits))
        return reduce(DataFrame.unionByName, layers)

    def _level(self, cells: DataFrame, deltas: DataFrame, remade: Callable[[DataFrame], DataFrame], fits: bool | None) -> DataFrame:
        """The changed cells as they are now, stored. `remade` makes the edges of cells anew."""
        held = lookup(cells, deltas.select(*KEYS), KEYS, "left_semi", fits=fits).withColumnsRenamed({c: f"old_{c}" for c in [*ADDED, *EDGES]})
        met = lookup(deltas, held, KEYS, fits=fits)
        lost = reduce(lambda a, b: a | b, [F.col(f"gone_{edge}").eqNullSafe(F.col(f"old_{edge}")) & F.col(f"old_{edge}").isNotNull() for edge in EDGES])
        met = materialize(met.withColumn("lost", lost), "met-cells")
        types = dict(cells.dtypes)
        added = [(F.coalesce(f"old_{c}", F.lit(0).cast(types[c])) + F.col(c)).cast(types[c]).alias(c) for c in ADDED]
        keep = lambda edge, f: (F.least if f is F.min else F.greatest)(F.col(f"old_{edge}"), F.col(f"new_{edge}")).alias(edge)
        whole = met.where("not lost").select(*KEYS, *added, *[keep(edge, f) for edge, (f, _) in EDGES.items()])
        again = lookup(met.where("lost").select(*KEYS, *added), remade(met.where("lost")), KEYS, fits=fits)
        return materialize(whole.unionByName(again).select(*cells.columns), "changed-cells")
