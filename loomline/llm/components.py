"""Connected components of links, by label propagation with pointer jumping on written tables; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, dropped, scoped, written


@scoped
def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label (the smallest node of its component) of every node that has a link. Null ends and loops are left out.

    A round takes each node's least neighbouring label, then the label's own label, so long chains halve. Nodes with very many links are
    never gathered: their label is broadcast to their links (attach), minima are summed per task first.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    edges = written(ends.unionByName(ends.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    total = edges.count()
    nodes = edges.groupBy("x").agg(F.count(F.lit(1)).alias("degree"), F.min("y").alias("least"))
    labels = written(nodes.select(F.col("x").alias("node"), "degree", F.least("x", "least").alias("label")), "labels")
    n_nodes = labels.count()
    while n_nodes:
        near = attach(edges, labels.select(F.col("node"), "degree", F.col("label").alias("seen")).withColumnRenamed("node", "x"), "x", "degree", total)
        best = near.groupBy("y").agg(F.min("seen").alias("best"))
        lower = labels.join(best, labels["node"] == best["y"]).select("node", "degree", F.col("label").alias("was"), F.least("label", "best").alias("label"))
        stepped = written(lower, "labels")
        sizes = stepped.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
        up = sizes.join(stepped.select(F.col("node").alias("label"), F.col("label").alias("up")), "label")
        jumped = written(attach(stepped, up, "label", "members", n_nodes).select("node", "degree", "was", F.coalesce("up", "label").alias("label")), "labels")
        changed = jumped.where("label <> was").limit(1).count()
        dropped(labels)
        dropped(stepped)
        labels = jumped.select("node", "degree", "label")
        if not changed:
            break
    dropped(edges)
    return labels.select("node", "label")
