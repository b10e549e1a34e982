"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.tables import written


def components(links: DataFrame) -> DataFrame:
    """(v, label) for every end of links(a, b): label is the smallest vertex that v reaches.

    A round takes each vertex's least neighbouring label and then the label's own label, so
    that long chains shrink by powers of two. Each round is a written table: hot vertices only
    meet partial aggregates and joins that Spark can split, and no round's lineage is kept.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    edges = written(both.distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        least = labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = least.join(labels.select(F.col("v").alias("mid"), F.col("label").alias("up")), "mid", "left")
        step = written(jump.select("v", "old", F.least("mid", F.coalesce("up", "mid")).alias("label")), "labels")
        labels = step.select("v", "label")
        if step.where("old <> label").isEmpty():
            return labels
