import random

import pytest
from pyspark.sql import functions as F

from placebook.operators.clusters import cluster_points
from placebook.operators.pyramid import Pyramid
from placebook.session import new_folder

POINT = "id long, lat double, lng double, selected boolean"


def rows(df):
    exact = [F.round(c, 9).alias(c) if c in ("lat", "lng") else F.col(c) for c in df.columns]
    return sorted((tuple(row) for row in df.select(*exact).collect()), key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0))


def fresh(spark, state):
    """All clusters made anew."""
    points = spark.createDataFrame([(i, *p) for i, p in state.items()], POINT)
    chosen = points.where("selected").select("id")
    return rows(cluster_points(points.drop("selected"), range(20), selected=chosen))


@pytest.mark.parametrize("seed", [1])
def test_changes_equal_a_new_pyramid(spark, seed):
    rng = random.Random(seed)
    # Few places, so that cells lose points at their edges, some of several points in one place.
    place = lambda: (rng.choice([48.1, 48.1001, 48.2, -20.5, 0.0, 85.3]), rng.choice([2.1, 2.1001, 2.5, 170.0, -3.25]), rng.random() < 0.2)
    state = {i: place() for i in range(60)}
    pyramid = Pyramid.create(spark.createDataFrame([(i, *p) for i, p in state.items()], POINT), new_folder(spark, "pyramid"))
    assert rows(pyramid.read(range(20))) == fresh(spark, state)
    first = rows(pyramid.read(range(18)))
    for step in range(2):
        changes = []
        for i in rng.sample(range(75), 25):
            what = rng.random()
            p = (None, None, None) if what < 0.35 else state.get(i, place()) if what < 0.45 else place()
            changes.append((i, *p, step))
            state.pop(i, None)
            if p[0] is not None:
                state[i] = p
        df = spark.createDataFrame([(None, 1.0, 1.0, True, 0), (3, 9.0, 9.0, True, -1), *changes, *([(3, *state[3], 9)] if 3 in state else [(3, None, None, None, 9)])], f"{POINT}, step int")
        number = pyramid.apply(df, ["step"], ("feed", step))
        assert pyramid.apply(df, ["step"], ("feed", step)) == number  # a repeated batch has no effect
    assert rows(pyramid.read(range(20))) == fresh(spark, state)
    assert rows(pyramid.read(range(18), version=0)) == first


def test_a_batch_cut_short_is_finished(spark):
    points = spark.createDataFrame([(1, 10.0, 10.0, False), (2, 20.0, 20.0, True)], POINT)
    pyramid = Pyramid.create(points, new_folder(spark, "pyramid"))
    moved = spark.createDataFrame([(1, 20.0, 20.0, False, 0), (2, None, None, None, 0)], f"{POINT}, step int")
    put, pyramid.points.put = pyramid.points.put, lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        pyramid.apply(moved, ["step"], ("feed", 0))
    pyramid.points.put = put
    pyramid.apply(moved, ["step"], ("feed", 0))
    assert rows(pyramid.read(range(20))) == fresh(spark, {1: (20.0, 20.0, False)})


def test_empty_pyramids(spark):
    pyramid = Pyramid.create(spark.createDataFrame([], POINT), new_folder(spark, "pyramid"))
    assert pyramid.read().collect() == []
    pyramid.apply(spark.createDataFrame([], f"{POINT}, step int"), ["step"])
    one = spark.createDataFrame([(5, 1.0, 2.0, None, 0)], f"{POINT}, step int")
    pyramid.apply(one, ["step"])
    assert rows(pyramid.read(range(20))) == fresh(spark, {5: (1.0, 2.0, False)})
    pyramid.apply(one.withColumn("lat", F.lit(None).cast("double")), ["step"])
    assert pyramid.read().collect() == []
    with pytest.raises(ValueError, match="alone"):
        pyramid.read([18], version=0)
