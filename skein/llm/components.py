"""Connected components of an edge table, by repeated neighbour minima and pointer jumping."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, meet, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node of its component.

    Each round takes the least label among a node's neighbours (a partial aggregate, so hubs are
    pre-aggregated before the shuffle) and then follows the label's own label once, which doubles the
    distance that a label travels. Nodes with many edges and labels that many nodes have are broadcast; there are a thousand
    at most of each. Every round is written to the shared folder and the one before is removed. No edges: no rows.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"), F.count("*").alias("edges"))
    labels = written(labels.select("node", F.least("node", "low").alias("root"), "edges"), "labels")
    sizes = labels.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("edges"), F.lit(0)).alias("edges")).first()
    while True:
        ends = labels.select(F.col("node").alias("b"), "root", "edges")
        near = meet(both, ends, "b", F.col("edges") > sizes.edges // 1000).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", "root", "edges", F.least("root", "near").alias("next"))
        lower = written(lower, "lower")
        used = lower.groupBy("next").agg(F.count("*").alias("users"))
        jump = written(labels.select(F.col("node").alias("next"), F.col("root").alias("further")).join(used, "next"), "jump")
        found = meet(lower, jump, "next", F.col("users") > sizes.nodes // 1000)
        moved = written(found.select("node", F.col("root").alias("old"), F.least("next", "further").alias("root"), "edges"), "labels")
        discard(labels, lower, jump)
        labels = moved
        if moved.where("old <> root").isEmpty():
            discard(both)
            return labels.select("node", "root")
