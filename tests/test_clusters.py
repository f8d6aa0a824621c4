import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from placebook.operators.clusters import bounds, cluster_points, fit_zoom, flag_selected
from placebook.operators.filters import select_records


@pytest.fixture(scope="module")
def some(spark):
    pick = random.Random(1)
    near = [(i, 2.35 + pick.gauss(0, 0.01), 48.85 + pick.gauss(0, 0.01)) for i in range(150)]
    far = [(1000 + i, pick.uniform(-180, 180), pick.uniform(-89.9, 89.9)) for i in range(50)]
    points = near + far
    return points, spark.createDataFrame(points, "id long, lng double, lat double").repartition(3)


def cell(lng, lat, zoom, radius=30):
    size = 256 * 2**zoom
    sine = math.sin(math.radians(max(min(lat, 85.0511), -85.0511)))
    return math.floor(size * (lng + 180) / 360 / radius), math.floor(size * (0.5 - math.log((1 + sine) / (1 - sine)) / (4 * math.pi)) / radius)


def test_every_zoom_against_single_points(some):
    points, df = some
    got = {(row["zoom"], row["cx"], row["cy"]): row for row in cluster_points(df, selected=3).collect()}
    expected = defaultdict(list)
    for zoom in range(18):
        for point in points:
            expected[(zoom, *cell(point[1], point[2], zoom))].append(point)
    assert set(got) == set(expected)
    for key, members in expected.items():
        row, lngs, lats = got[key], [p[1] for p in members], [p[2] for p in members]
        assert row["n"] == len(members)
        assert (row["min_lng"], row["max_lng"], row["min_lat"], row["max_lat"]) == (min(lngs), max(lngs), min(lats), max(lats))
        assert row["lng"] == pytest.approx(sum(lngs) / len(lngs)) and row["lat"] == pytest.approx(sum(lats) / len(lats))
        assert row["id"] == (members[0][0] if len(members) == 1 else None)
        assert row["has_selected"] == any(p[0] == 3 for p in members)
        assert row["size_class"] == ("small" if len(members) < 10 else "medium" if len(members) < 100 else "large")


def test_some_zooms_and_single_points(some):
    points, df = some
    rows = cluster_points(df, [18, 3, 20, 9], radius=60).collect()
    total = defaultdict(int)
    for row in rows:
        total[row["zoom"]] += row["n"]
    assert total == {3: 200, 9: 200, 18: 200, 20: 200}
    assert {row["cx"] for row in rows if row["zoom"] == 18} == {p[0] for p in points}
    assert {(row["cx"], row["cy"]) for row in rows if row["zoom"] == 9} == {cell(p[1], p[2], 9, 60) for p in points}


def test_only_single_points(some):
    assert cluster_points(some[1], [19]).count() == 200


def test_points_are_read_once_for_all_clusters(some, plan_of):
    plan = plan_of(cluster_points(some[1].withColumn("mark", F.lit(1)).drop("mark"), range(18)))
    assert plan.count("Scan ExistingRDD") == 0  # all read from the stored finest cells


def test_selected_by_table(spark, some):
    chosen = spark.createDataFrame([(3,), (3,), (1001,), (99999,)], "id long")
    assert sorted(row["id"] for row in flag_selected(some[1], chosen).where("selected").collect()) == [3, 1001]
    assert flag_selected(some[1], chosen).count() == 200
    assert flag_selected(some[1], None).where("selected").count() == 0
    assert sorted(row["id"] for row in select_records(some[1], chosen).collect()) == [3, 1001]
    assert [row["id"] for row in select_records(some[1], 3).collect()] == [3]


def test_bounds(spark, some):
    points, df = some
    assert tuple(bounds(df).first()) == (min(p[2] for p in points), min(p[1] for p in points), max(p[2] for p in points), max(p[1] for p in points))
    assert tuple(bounds(df.limit(0)).first()) == (None,) * 4


def test_fitting_zoom(spark):
    boxes = spark.createDataFrame(
        [(1, 0.0, -180.0, 0.0, 180.0), (2, 0.0, -45.0, 0.0, 45.0), (3, 1.0, 1.0, 1.0, 1.0), (4, None, None, None, None), (5, -80.0, 0.0, 80.0, 0.0)],
        "i int, min_lat double, min_lng double, max_lat double, max_lng double",
    )
    assert [row["zoom"] for row in fit_zoom(boxes, 512, 512).orderBy("i").collect()] == [1, 3, 15, None, 1]
