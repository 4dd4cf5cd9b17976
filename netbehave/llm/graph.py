"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netbehave.llm.words import stored


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, label) for the nodes of ``edges`` (a, b); the label is the least node.

    Each round gives a node the least label around it and then the label of its label,
    so the number of rounds grows with the logarithm of the longest path for the
    star-shaped edges used here. Rounds are written to the shared folder, and nothing but
    the number of changed labels reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = stored(both.toDF("a", "b"), "edges")
    labels = stored(
        both.groupBy("a").agg(F.min("b").alias("least")).select(
            F.col("a").alias("node"), F.least("a", "least").alias("label")
        ),
        "labels",
    )
    while True:
        around = (
            both.join(labels, both["b"] == labels["node"])
            .groupBy("a")
            .agg(F.min("label").alias("around"))
        )
        near = labels.join(around, labels["node"] == around["a"]).select(
            "node", F.col("label").alias("was"), F.least("label", "around").alias("near")
        )
        # Every label is itself a node, so the join keeps every row.
        far = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        new = stored(
            near.join(far, "near").select("node", "was", F.least("near", "far").alias("label")),
            "labels",
        )
        if new.where("label <> was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
