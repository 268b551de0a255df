"""Connected components of an edge table, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.

    Each round takes the smallest label among the neighbours and then the label of that label, so labels travel
    doubling distances along paths of labels; a round's table is written, and rounds end when no label changes.
    """
    spark = edges.sparkSession
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select("b", "a")).toDF("node", "other").distinct()
    both = materialize(spark, both, "edges")
    labels = materialize(spark, both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), "labels")
    while True:
        near = both.join(labels.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        least = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("least"))
        far = labels.toDF("least", "far")
        after = least.join(far, "least", "left").select("node", "root", F.least("least", F.coalesce("far", "least")).alias("new"))
        after = materialize(spark, after, "labels")
        labels = after.select("node", F.col("new").alias("root"))
        if after.where("new <> root").isEmpty():
            return labels
