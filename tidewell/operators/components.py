"""Connected components of a link table, by stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.scratch import materialize


def _least(links: DataFrame) -> DataFrame:
    """(node, least): of each node's partners in b, and itself, the smallest."""
    return links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("least"))


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node.

    Alternates two steps that keep components as they are: a node's larger partners are linked to the smallest of its
    partners and itself (large star), then a node and its smaller partners to the smallest of these (small star).  Chains
    shorten by half or more each time, so rounds grow with the logarithm of a component's diameter.  Each step has as many
    links as nodes at most after the first, is written, and gathers no node's links in one task.  It ends when every node but
    the smallest has one link, to a node that has none.  A node linked only to itself is its own component; null ends are dropped.
    """
    links = links.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    nodes = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    open_ = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = open_.unionByName(open_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.filter("b > a").join(_least(both), F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = materialize(large, "large-star")
        least = _least(large)
        small = large.join(least, F.col("a") == F.col("node")).filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b"))).distinct()
        open_ = materialize(small.filter("a <> b"), "small-star")
        inner = open_.join(open_.select(F.col("a").alias("x")), F.col("b") == F.col("x"), "left_semi")
        if inner.isEmpty() and open_.groupBy("a").count().filter("count > 1").isEmpty():
            return nodes.join(open_, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("component"))
