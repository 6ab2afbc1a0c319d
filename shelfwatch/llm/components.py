"""Connected components of a large graph, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shelfwatch.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the least node connected with it.

    Each round every node takes the least label of itself and its neighbours,
    then its label's label, so paths shrink by half or more and the number of
    rounds grows with the logarithm of the longest path. A node with very many
    links is cut down by the map-side minimum, its labels are joined to links
    that Spark can split. Each round is written to the shared folder.
    """
    both = materialise(links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct(), "links")
    labels = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
            .withColumnRenamed("a", "node")
        )
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = materialise(lower, "labels")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("far"))
        after = lower.join(jump, "label").select("node", F.col("far").alias("label"), (F.col("far") < F.col("old")).alias("moved"))
        after = materialise(after, "labels")
        labels = after.select("node", "label")
        if after.where("moved").isEmpty():
            return labels
