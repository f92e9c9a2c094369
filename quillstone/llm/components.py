"""Connected components of an undirected graph held as a table of edges, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import dropped, joined, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node reachable.

    Each round gives a node the smallest label among its neighbours and then the label of that label, so that chains
    halve. Rounds end when no label changes. Hot nodes are joined by `joined`; minima combine before the shuffle.
    Self-loops are allowed; edges with a null end are left out. An empty input gives an empty result.
    """
    both = edges.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("other")).dropna()
    both = written(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    total = both.count()
    labels = written(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "labels")
    while True:
        seen = joined(both.select(F.col("other").alias("key"), "node"), labels.withColumnsRenamed({"node": "key", "component": "near"}), "key", total=total)
        near = seen.groupBy("node").agg(F.min("near").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("key"))
        step = written(step, "step")
        jump = joined(step, step.select(F.col("node").alias("key"), F.col("key").alias("far")), "key", "left")
        after = written(jump.select("node", "old", F.coalesce(F.least("key", "far"), "key").alias("component")), "labels")
        changed = after.filter("old <> component").limit(1).count()
        dropped(step)
        dropped(labels)
        labels = after
        if not changed:
            dropped(both)
            return labels.select("node", "component")
