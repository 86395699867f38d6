"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salience.session import scratch_path


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the session's shared scratch folder: computed once, safe against lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of (a, b); the label is the smallest node that edges reach.

    Every round takes the smallest label among the neighbours and then the label of the label, so long chains shrink
    fast. Labels of a round are a table of their own. Hot nodes are split by adaptive joins; groupings combine first.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a"), "left").select(
            "node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        over = labels.select(F.col("node").alias("over"), F.col("label").alias("above"))
        labels = stored(lower.join(over, F.col("label") == F.col("over"), "left").select("node", "was", F.least("label", "above").alias("label")), "labels")
        if labels.filter("label <> was").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
