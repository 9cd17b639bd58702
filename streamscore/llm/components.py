"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamscore.sources.storage import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all ends of `edges` (a, b); nodes of a component share a label.

    Every round each node joins the neighbour that comes first in an order drawn
    anew by hashing, and edges are rewritten to the nodes that remain. That removes a
    constant share of the nodes per round, whatever the shape of the graph, so rounds
    grow with the logarithm of their number. Only whether edges are left reaches the
    driver; tables in between are written to the shared folder.
    """
    edges = stored(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = nodes.withColumn("label", F.col("node"))
    turn = 0
    while not edges.isEmpty():
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        drawn = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("draw"), F.col(c).alias("node"))  # noqa: B023, E731
        first = ways.groupBy("a").agg(F.min(drawn("b")).alias("best"))
        first = first.select("a", F.least("best", drawn("a"))["node"].alias("to"))
        first = stored(first, "first")
        labels = labels.join(first, F.col("label") == F.col("a"), "left").select(
            "node", F.coalesce("to", "label").alias("label")
        )
        to_a, to_b = first.toDF("a", "to_a"), first.toDF("b", "to_b")
        moved = edges.join(to_a, "a").join(to_b, "b").filter("to_a <> to_b")
        ends = (F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        edges = stored(moved.select(*ends).distinct(), "edges")
        turn += 1
    return stored(labels, "labels")


def joined_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The components of `labels` joined along further edges (a, b)."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    both = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = [F.coalesce(f"label_{c}", c).alias(c) for c in ("a", "b")]
    merged = components(both.select(*ends)).toDF("label", "joined")
    single = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    single = single.join(labels, "node", "left_anti").withColumn("label", F.col("node"))
    every = labels.unionByName(single).join(merged, "label", "left")
    return every.select("node", F.coalesce("joined", "label").alias("label"))
