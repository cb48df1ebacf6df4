"""Connected components of an edge table, in rounds of joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake.llm.store import forget, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of ``edges`` (a long, b long) the smallest node reachable from it.

    Each round takes the smallest label among a node and its neighbours, then follows that label once (pointer
    jumping), so long chains halve. Rounds end when no label changes. A hub's neighbours are pre-aggregated before the
    shuffle, and its joins are sort-merge joins that AQE splits. An empty edge table gives an empty result.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("_m"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("_was"), F.least("component", "_m").alias("_to"))
        jump = labels.select(F.col("node").alias("_n"), F.col("component").alias("_next"))
        new = written(step.join(jump, F.col("_to") == F.col("_n"), "left").select("node", "_was", F.least("_to", F.coalesce("_next", "_to")).alias("component")), "labels")
        moved = new.where("component <> _was").limit(1).count()
        forget(labels)
        path, labels = new._codelake_path, new.select("node", "component")
        labels._codelake_path = path
        if not moved:
            forget(both)
            return labels
