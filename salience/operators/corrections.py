"""Multiple-testing correction and the tables on corrected tests.

Tests are aggregates, one row per dataset, metric and checkpoint, so their windows are small at any corpus size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from salience.functions.text import r6

ALPHA = 0.05


def corrected(tests: DataFrame, family: list[str] | None = None) -> DataFrame:
    """Adds ``p_holm, p_bh, family_size, family_name``. The family is a list of columns, by default the dataset;
    an empty list makes one family of all tests."""
    family = ["dataset"] if family is None else family
    part = family or [F.lit("ALL")]
    order = [F.col("p_raw"), F.col("metric"), F.col("checkpoint"), F.col("dataset")]
    up = W.partitionBy(*part).orderBy(*order)
    whole = W.partitionBy(*part)
    ranked = tests.filter(F.col("p_raw").isNotNull()).select(
        "*", F.row_number().over(up).alias("_k"), F.count("*").over(whole).alias("family_size"))
    return ranked.select(
        "*",
        F.least(F.lit(1.0), F.max((F.col("family_size") - F.col("_k") + 1) * F.col("p_raw")).over(
            up.rowsBetween(W.unboundedPreceding, W.currentRow))).alias("p_holm"),
        F.least(F.lit(1.0), F.min(F.col("p_raw") * F.col("family_size") / F.col("_k")).over(
            up.rowsBetween(W.currentRow, W.unboundedFollowing))).alias("p_bh"),
        (F.concat_ws("|", *family) if family else F.lit("ALL")).alias("family_name")).drop("_k")


def rounded(tests: DataFrame) -> DataFrame:
    return tests.select("dataset", "metric", "checkpoint", "direction", "family_name", "family_size",
                        *[r6(F.col(c)).alias(c) for c in ("p_raw", "p_holm", "p_bh")])


def lost_significance(tests: DataFrame, alpha: float = ALPHA) -> DataFrame:
    return tests.filter((F.col("p_raw") < alpha) & (F.col("p_bh") >= alpha)).orderBy("dataset", "metric", "checkpoint")


def tally(tests: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Wins, losses and the rest per metric, per dataset and in total, raw and corrected."""
    def side(p: str, d: str):
        return F.count_if((F.col(p) < alpha) & (F.col("direction") == d))

    sums = tests.rollup("dataset", "metric").agg(
        F.grouping("dataset").alias("_gd"), F.grouping("metric").alias("_gm"), F.count("*").alias("tests"),
        side("p_raw", "HIGHER").alias("raw_wins"), side("p_raw", "LOWER").alias("raw_losses"),
        side("p_bh", "HIGHER").alias("bh_wins"), side("p_bh", "LOWER").alias("bh_losses"))
    return sums.select(
        F.when(F.col("_gd") == 1, "TOTAL").otherwise(F.col("dataset")).alias("dataset"),
        F.when(F.col("_gm") == 1, "ALL").otherwise(F.col("metric")).alias("metric"),
        "tests", "raw_wins", "raw_losses", "bh_wins", "bh_losses",
        (F.col("tests") - F.col("bh_wins") - F.col("bh_losses")).alias("bh_rest"))
