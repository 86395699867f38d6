"""Test results that exist only as printed reports, one text file per checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The two line patterns and the file-name pattern of the reports.
P_LINE = r"p-value for <(\w+)> dataset for '(\w+)' metric between both models:\s*([-+0-9.eE]+)"
SIDE_LINE = r"mean is (HIGHER|LOWER) than the second model \(\w+\) for <(\w+)> dataset"
NAME = r"-(\w+) pt-"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """``dataset, metric, checkpoint, p_raw, direction, mismatch``.

    The k-th p-value of a file belongs to the k-th direction line; a direction about another dataset is dropped.
    ``mismatch`` marks files in which the two counts differ. Each file is one checkpoint's printout.
    """
    files = spark.read.text(path, wholetext=True).select(
        "value", F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -2)).alias("folder"),
        F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -1)).alias("file"))
    grab = lambda pattern, i: F.regexp_extract_all("value", F.lit(pattern), F.lit(i))
    named = files.select(
        F.coalesce(F.nullif(F.regexp_extract("file", NAME, 1), F.lit("")), F.regexp_extract("folder", NAME, 1)).alias("checkpoint"),
        F.arrays_zip(grab(P_LINE, 1).alias("dataset"), grab(P_LINE, 2).alias("metric"), grab(P_LINE, 3).alias("p")).alias("ps"),
        F.arrays_zip(grab(SIDE_LINE, 1).alias("side"), grab(SIDE_LINE, 2).alias("about")).alias("sides"))
    rows = named.filter("checkpoint <> ''").select(
        "checkpoint", "sides", (F.size("ps") != F.size("sides")).alias("mismatch"), F.posexplode("ps").alias("k", "x"))
    side = F.get("sides", F.col("k"))
    return rows.select(
        "x.dataset", "x.metric", "checkpoint", F.col("x.p").cast("double").alias("p_raw"),
        F.when(side["about"] == F.col("x.dataset"), side["side"]).alias("direction"), "mismatch")


def write_report(tests: DataFrame, path: str) -> None:
    """The printed form: a folder per checkpoint, named as the reader expects, one text per checkpoint."""
    line = F.concat(
        F.lit("Paired t-test p-value for <"), "dataset", F.lit("> dataset for '"), "metric", F.lit("' metric between both models: "),
        F.col("p_raw").cast("string"), F.lit("\n--> The first model (A) mean is "), "direction",
        F.lit(" than the second model (B) for <"), "dataset", F.lit("> dataset."))
    texts = tests.groupBy("checkpoint").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n\n").alias("value"))
    texts.select("value", F.concat(F.lit("t-test-"), "checkpoint", F.lit(" pt-models")).alias("report")).write.partitionBy("report").text(path)
