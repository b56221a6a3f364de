"""Connected components of a link table by label propagation with pointer jumping, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialize


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its smallest node.

    Each round every node takes the smallest label among itself, its neighbours and the label of its label.  Minima
    are combined map-side, so a node with many links does not gather them in one task.  Rounds end when no label changes;
    each is written to the shared folder, which cuts lineage and survives lost executors.  Self links and repeated links
    do no harm; null ends are dropped.
    """
    links = links.select("a", "b").filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "component")
        jump = labels.alias("x").join(labels.alias("y"), F.col("x.component") == F.col("y.node")).select(F.col("x.node").alias("node"), F.col("y.component").alias("component"))
        new = materialize(
            labels.select("node", "component", F.col("component").alias("old"))
            .unionByName(near.unionByName(jump).withColumn("old", F.lit(None).cast(labels.schema["component"].dataType)))
            .groupBy("node")
            .agg(F.min("component").alias("component"), F.max("old").alias("old")),
            "labels",
        )
        labels = new.select("node", "component")
        if new.filter(F.col("component") != F.col("old")).isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
