"""Agreement of selectors: which sentence each picked for the same document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salience.functions import text as tx
from salience.functions.moments import correlation

# Lower bounds of the sentence-count bins, and the open upper end.
LENGTH_EDGES = [1, 11, 21, 31, 41, 51, 71, 1000]


def _plain(pairs: DataFrame, name: str) -> DataFrame:
    """Summaries and the restored source texts, which are only compared: their SHA-256 travels instead of the text."""
    source = tx.plain_quotes(tx.unmask(F.col("document"), F.col("summary")))
    return pairs.select("doc_id", tx.plain_quotes(F.col("summary")).alias(f"s_{name}"), F.sha2(source, 256).alias(f"source_{name}"))


def two_way(rows: DataFrame) -> DataFrame:
    """Class of rows holding ``s_a, s_b`` and the restored ``source_a, source_b`` or their digests, quotes already unified."""
    same = F.col("s_a") == F.col("s_b")
    return rows.select(
        "doc_id",
        F.when(same, "same").when(tx.almost_same(F.col("s_a"), F.col("s_b")), "almost").otherwise("different").alias("class"),
        (F.col("source_a") != F.col("source_b")).alias("misaligned"))


def compare_two(a: DataFrame, b: DataFrame) -> DataFrame:
    """``doc_id, class (same/almost/different), misaligned`` for two stored sets of pairs, matched by document."""
    return two_way(_plain(a, "a").join(_plain(b, "b"), "doc_id"))


def three_way(rows: DataFrame) -> DataFrame:
    """Class and almost-same flags for rows holding ``s_a, s_b, s_c``, quotes already unified."""
    ab, ac, bc = F.col("s_a") == F.col("s_b"), F.col("s_a") == F.col("s_c"), F.col("s_b") == F.col("s_c")
    near = lambda x, y: (F.col(x) != F.col(y)) & tx.almost_same(F.col(x), F.col(y))
    return rows.select(
        "doc_id",
        F.when(ab & ac, "all_same").when(ab, "c_differs").when(ac, "b_differs").when(bc, "a_differs").otherwise("all_differ").alias("class"),
        near("s_a", "s_b").alias("almost_ab"), near("s_a", "s_c").alias("almost_ac"), near("s_b", "s_c").alias("almost_bc"),
        *([((F.col("source_a") != F.col("source_b")) | (F.col("source_a") != F.col("source_c"))).alias("misaligned")]
          if "source_a" in rows.columns else []))


def compare_three(a: DataFrame, b: DataFrame, c: DataFrame) -> DataFrame:
    return three_way(_plain(a, "a").join(_plain(b, "b"), "doc_id").join(_plain(c, "c"), "doc_id"))


def agreement_report(classes: DataFrame) -> DataFrame:
    """``item, n, pct``: the five exclusive classes, the three pairwise agreements, the almost-same pairs."""
    is_ = lambda *names: F.count_if(F.col("class").isin(*names))
    items = {
        "all_same": is_("all_same"), "all_differ": is_("all_differ"), "c_differs": is_("c_differs"),
        "b_differs": is_("b_differs"), "a_differs": is_("a_differs"),
        "agree_ab": is_("all_same", "c_differs"), "agree_ac": is_("all_same", "b_differs"), "agree_bc": is_("all_same", "a_differs"),
        "almost_ab": F.count_if("almost_ab"), "almost_ac": F.count_if("almost_ac"), "almost_bc": F.count_if("almost_bc"),
    }
    one = classes.agg(F.count("*").alias("_total"), *[e.alias(k) for k, e in items.items()])
    return one.unpivot(["_total"], list(items), "item", "n").select(
        "item", "n", tx.r6(tx.percent(F.col("n"), F.col("_total"))).alias("pct"))


def length_bin(n):
    """Lower edge of the sentence-count bin, NULL outside all bins."""
    out = F.lit(None).cast("long")
    for lo, hi in zip(LENGTH_EDGES, LENGTH_EDGES[1:]):
        out = F.when((n >= lo) & (n < hi), F.lit(lo).cast("long")).otherwise(out)
    return out


def disagreement_by_length(rows: DataFrame) -> DataFrame:
    """Rate and share per sentence-count bin for rows ``n_sents, differs``; empty bins report 0."""
    spark = rows.sparkSession
    edges = spark.createDataFrame([(lo,) for lo in LENGTH_EDGES[:-1]], "bin LONG")
    total = rows.select(F.count("*")).scalar()
    stats = rows.withColumn("bin", length_bin(F.col("n_sents"))).groupBy("bin").agg(
        F.count("*").alias("n"), F.avg(F.col("differs").cast("double")).alias("rate"))
    return edges.join(stats, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"), tx.r6(F.coalesce("rate", F.lit(0.0))).alias("rate"),
        tx.r6(tx.percent(F.coalesce("n", F.lit(0)), total)).alias("share"))


def length_correlation(rows: DataFrame) -> DataFrame:
    """Point-biserial correlation of length and disagreement, with the mean lengths beside it."""
    d = F.col("differs").cast("double")
    n = F.col("n_sents").cast("double")
    return rows.agg(
        tx.r6(correlation(n, d)).alias("r"), tx.r6(F.avg(F.when(~F.col("differs"), n))).alias("mean_same"),
        tx.r6(F.avg(F.when(F.col("differs"), n))).alias("mean_different"), tx.r6(F.avg(n)).alias("mean_all"))


def first_differences(classes: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The first k documents on which the selectors differ, with their summaries."""
    lowest = classes.filter(~F.col("class").isin("same", "all_same")).select("doc_id", "class").orderBy("doc_id").limit(k)
    return texts.join(F.broadcast(lowest), "doc_id")
