"""Connected components of a distributed edge list, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.llm.storage import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` for the nodes of ``edges`` (long columns ``a`` and ``b``); the component is its smallest node.

    Each round points every node at its smallest neighbour (or itself), follows pointers to their roots by doubling, puts
    roots in the place of edge ends, and drops loops and repeats, so edges shrink from round to round; it ends when none is
    left. Each table is cut from its lineage in the shared folder. Neither nodes nor edges reach the driver, which sees
    counts only. Hubs are pre-aggregated before the shuffle (``min``). Loops, repeated and null edges do no harm; no edges
    give no rows.
    """
    edges = edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = written(edges.distinct(), f"{name}-edges")
    labels = None
    while labels is None or edges.limit(1).count():
        roots = _roots(edges, name)
        if labels is None:
            labels = roots
        else:
            moved = roots.select(F.col("node").alias("component"), F.col("component").alias("root"))
            labels = labels.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
            labels = written(labels, f"{name}-labels")
        a = roots.select(F.col("node").alias("a"), F.col("component").alias("x"))
        b = roots.select(F.col("node").alias("b"), F.col("component").alias("y"))
        lifted = edges.join(a, "a").join(b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = written(lifted.distinct(), f"{name}-edges")
    return labels


def _roots(edges: DataFrame, name: str) -> DataFrame:
    """Where the pointers at smallest neighbours lead; they only ever descend, so they end."""
    ends = edges.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("node"), F.col("m").alias("component"))
    ends = ends.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    pointers = written(ends.groupBy("node").agg(F.min("component").alias("component")), f"{name}-pointers")
    while True:
        far = pointers.select(F.col("node").alias("component"), F.col("component").alias("far"))
        jumped = pointers.join(far, "component").select("node", F.col("far").alias("component"), (F.col("far") != F.col("component")).alias("moved"))
        jumped = written(jumped, f"{name}-pointers")
        pointers = jumped.select("node", "component")
        if not jumped.filter("moved").limit(1).count():
            return pointers


def extended(groups: DataFrame, edges: DataFrame, name: str = "components") -> DataFrame:
    """The components after more edges, from those before: only edges between components go through the rounds again."""
    lifted = labelled(labelled(edges.select("a", "b"), groups, "a"), groups, "b")
    lifted = written(lifted, f"{name}-lifted")
    joins = components(lifted.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")), name)
    nodes = groups.unionByName(lifted.select(F.col("a").alias("node"), F.col("label_a").alias("component"))).unionByName(lifted.select(F.col("b").alias("node"), F.col("label_b").alias("component"))).distinct()
    moved = joins.select(F.col("node").alias("component"), F.col("component").alias("root"))
    return written(nodes.join(moved, "component", "left").select("node", F.coalesce("root", "component").alias("component")), f"{name}-labels")


def labelled(df: DataFrame, groups: DataFrame, column: str) -> DataFrame:
    """``df`` with ``label_<column>``: the component of a node, which is itself where it has no edge yet."""
    own = groups.select(F.col("node").alias(column), F.col("component").alias("__label"))
    return df.join(own, column, "left").withColumn(f"label_{column}", F.coalesce("__label", column)).drop("__label")
