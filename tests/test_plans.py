"""What the library must not contain."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from placebook.operators import clusters
from placebook.operators.update import update_by_id
from placebook.plans.register import build_register
from placebook.session import materialize
from workload.queries import QUERIES
from workload.standins import view

ROOT = Path(__file__).resolve().parents[1]


def test_nothing_is_pulled_through_the_driver():
    sources = [path.read_text("utf8") for path in (ROOT / "placebook").rglob("*.py")]
    for forbidden in ("localCheckpoint", ".collect()", "toPandas", "toLocalIterator", "crossJoin", ".rdd"):
        assert not any(forbidden in source for source in sources), forbidden


def exchanges(plan):
    return len(re.findall(r"(?m)^\(\d+\) Exchange", plan))


def test_six_cluster_levels_need_one_exchange(spark, plan_of):
    points = spark.range(500).selectExpr("id", "id % 90 as lng", "id % 80 as lat", "false as selected")
    cells = materialize(clusters._finest(points, 17, clusters.RADIUS), "test-cells")
    plan = plan_of(clusters._coarser(cells, 17, [16, 15, 14, 13, 12, 11]))
    assert exchanges(plan) == 1


def test_small_updates_leave_the_target_in_place(spark, plan_of):
    target = materialize(spark.range(100).selectExpr("id", "'x' as v"), "test-target")
    updates = materialize(spark.range(5).selectExpr("id", "'y' as v"), "test-updates")
    plan = plan_of(update_by_id(target, updates, ["v"], ["v"]))
    assert exchanges(plan) <= 1 and "BroadcastHashJoin LeftOuter" in plan  # the updates' own reduction to one row per id


@pytest.mark.parametrize("name", ["search_text", "normalize_scripts"])
def test_texts_of_a_single_file_are_normalised_in_many_tasks(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    tasks = df.select(F.spark_partition_id().alias("task"), df.columns[-1]).groupBy("task").agg(F.count(df.columns[-1]).alias("rows"))
    rows = [row["rows"] for row in tasks.collect()]
    assert len(rows) == 4 and max(rows) - min(rows) <= 1


def test_search_texts_are_made_of_numbered_rows(spark, sf_dir, plan_of):
    """Not in the tasks that read the register's files."""
    plan = plan_of(build_register(view(spark, sf_dir, "establishment")))
    assert "regexp_extract_all(" in plan and "customer.parquet" not in plan
