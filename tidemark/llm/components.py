"""Connected components of an edge list, by the smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import drop, join_hot, materialize


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node and component (the smallest node that it reaches), for every node of an edge.

    In each round a node takes the smallest label of its neighbours, and then the label
    of the node that its label names, so that labels travel ever farther. Neighbours'
    labels are aggregated before they are shuffled, and nodes with a large share of the
    edges, or of the labels that point to them, are joined apart. Each round is written,
    which keeps the plan short and lets later rounds survive lost executors; the round
    before goes. Nulls, loops and repeated edges do no harm; no edges give no rows.
    """
    edges = edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    both = materialize(edges.select(F.col(left).alias("_u"), F.col(right).alias("node")).unionByName(edges.select(F.col(right).alias("_u"), F.col(left).alias("node"))).distinct(), "edges")
    first = both.groupBy(F.col("_u").alias("node")).agg(F.least(F.min("node"), F.col("_u")).alias("component"), F.count(F.lit(1)).alias("_degree"))
    labels = materialize(first, "labels")
    total, nodes = both.count(), labels.count()
    while True:
        told = join_hot(both, labels, "node", "_degree", total).groupBy("_u").agg(F.min("component").alias("_least"))
        near = labels.join(told, labels["node"] == told["_u"]).select("node", "_degree", F.col("component").alias("_old"), F.least("component", "_least").alias("_at"))
        near = materialize(near, "near")
        pointed = near.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"))
        far = labels.select(F.col("node").alias("_at"), F.col("component").alias("_far")).join(pointed, "_at")
        jumped = join_hot(near, far, "_at", "_n", nodes)
        after = materialize(jumped.select("node", "_degree", "_old", F.least("_at", "_far").alias("component")), "labels")
        drop(labels, near)
        settled = after.where(F.col("_old") != F.col("component")).isEmpty()
        labels = after.select("node", "component", *([] if settled else ["_degree"]))
        labels._scratch_path = after._scratch_path
        if settled:
            drop(both)
            return labels
