"""Connected components by label spreading with shortcuts, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def connected(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges: a, b (bigint). Returns node, root with root the smallest node reachable; nodes without edges are absent.

    Each round takes the least label among neighbours, then the label's own label, so that the
    number of rounds follows the logarithm of a component's width. Labels are written to the shared
    folder each round. Aggregations are partial, and skewed joins are split at run time.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = common.materialize(spark, both, "edges")
    labels = common.materialize(spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("root", "l"), both.b == F.col("node")).groupBy("a").agg(F.min("l").alias("near"))
        step = labels.join(near, labels.node == near.a, "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = labels.select(F.col("node").alias("via"), F.col("root").alias("far"))
        step = step.join(jump, step.root == jump.via, "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root"))
        step = common.materialize(spark, step, "labels")
        moved = step.where("old <> root").limit(1).count()
        labels = step.select("node", "root")
        if not moved:
            return labels
