"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from placebook.operators.joins import skew_join
from placebook.session import materialize


def _renamed(edges: DataFrame, hooks: DataFrame) -> DataFrame:
    """The edges between what their ends hang on; each once, larger end first, none from a node to itself."""
    for end in ("a", "b"):
        to = hooks.select(F.col("u").alias(end), F.col("v").alias("_to"))
        edges = skew_join(edges, to, [end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return ends.where("a <> b").distinct()


def _flat(hooks: DataFrame) -> DataFrame:
    """Each node with the node at the end of its way. Ways lead to ever smaller nodes, so they end."""
    while True:
        further = hooks.select(F.col("u").alias("v"), F.col("v").alias("_further"))
        moved = materialize(skew_join(hooks, further, ["v"], "left"), "hooks")
        hooks = moved.select("u", F.coalesce("_further", "v").alias("v"))
        if moved.where(F.col("_further").isNotNull()).limit(1).count() == 0:
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), numbers; a component is named by its smallest node.

    Each node hooks onto its smallest neighbour if that is smaller; ways are followed to their ends and the graph is
    reduced to those, until no edge is left. All steps are joins of tables no longer than the edges; a node with very
    many neighbours is spread over tasks.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = nodes.select("node", F.col("node").alias("component"))
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while edges.limit(1).count():
        hooks = _flat(materialize(edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("v")), "hooks"))
        to = hooks.select(F.col("u").alias("component"), F.col("v").alias("_to"))
        labels = materialize(skew_join(labels, to, ["component"], "left").select("node", F.coalesce("_to", "component").alias("component")), "labels")
        edges = materialize(_renamed(edges, hooks), "edges")
    return labels
