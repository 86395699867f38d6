"""Principal sentences from sentence scores, and the training pairs made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from salience.functions import text as tx
from salience.operators.scale import rank_by_number, smallest_digests

TOP_K = 5


def top_k(scores: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k best sentences of each document, all when there are fewer; ties go to the earlier sentence."""
    order = W.partitionBy("doc_id").orderBy(F.desc("score"), "sid")
    return scores.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def first_best(score: str) -> Column:
    """Aggregate: the sentence with the highest score, the earliest among equals."""
    return F.max_by("sid", F.struct(F.col(score), -F.col("sid")))


def best(scores: DataFrame) -> DataFrame:
    return scores.groupBy("doc_id").agg(first_best("score").alias("sid"), F.max("score").alias("score"))


def candidate_lists(docs: DataFrame, scores: DataFrame, k: int = TOP_K) -> DataFrame:
    """One row per document with parallel lists of its k masked documents, summaries and scores, in text order."""
    picked = top_k(scores, k).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sid", "score"))).alias("picks"))
    rows = docs.select("doc_id", "text").join(picked, "doc_id").withColumn("sents", tx.sentences(F.col("text")))
    sent = lambda p: F.get("sents", p["sid"].cast("int"))
    return rows.select(
        "doc_id",
        F.transform("picks", lambda p: tx.masked(F.col("sents"), p["sid"])).alias("documents"),
        F.transform("picks", sent).alias("summaries"),
        F.transform("picks", lambda p: p["sid"]).alias("sids"),
        F.transform("picks", lambda p: p["score"]).alias("scores"))


def combine_candidates(lists: DataFrame, extra: str | None = None) -> DataFrame:
    """Final pair from candidate lists: the highest score wins, the first one among equals.

    ``extra`` names a list of 0/1 labels from outside; a 0 adds one point to its candidate. Lists are matched
    position by position and the shorter one decides.
    """
    score = F.col("scores")
    if extra is not None:
        n = F.least(F.size("scores"), F.size(extra))
        score = F.zip_with(F.slice("scores", F.lit(1), n), F.slice(extra, F.lit(1), n), lambda s, f: s + F.when(f == 0, 1.0).otherwise(0.0))
    scored = lists.withColumn("_s", score)
    at = F.array_position("_s", F.array_max("_s")).cast("int")
    picked = scored.withColumn("_at", at).filter("_at > 0")
    return picked.select(
        "doc_id", F.element_at("documents", F.col("_at")).alias("document"), F.element_at("summaries", F.col("_at")).alias("summary"),
        F.element_at("sids", F.col("_at")).alias("sid"), F.element_at("_s", F.col("_at")).alias("score"))


def masked_pairs(docs: DataFrame, picks: DataFrame) -> DataFrame:
    """The columns of ``picks`` with ``document, summary``; a document without a pick gets empty texts.

    Text is joined before it is split, so the splitting runs on the joined partitions.
    """
    rows = docs.select("doc_id", "text").join(picks, "doc_id", "left")
    made = rows.withColumn("sents", tx.sentences(F.col("text")))
    return made.select(
        *picks.columns,
        F.when(F.col("sid").isNull(), F.lit("")).otherwise(tx.masked(F.col("sents"), F.col("sid"))).alias("document"),
        F.coalesce(F.get("sents", F.col("sid").cast("int")), F.lit("")).alias("summary"))


def seeded_subset(df: DataFrame, group: str, key: str, n: int | None, seed: str = "subset") -> DataFrame:
    """The same ``n`` keys of each group on every run; all rows when ``n`` is None.

    Keys may repeat (one row per checkpoint): the draw is made on distinct keys, so every checkpoint sees the same.
    """
    if n is None:
        return df
    keys = df.select(group, key).distinct().withColumn("_h", tx.keyed_digest(seed, F.col(group), F.col(key)))
    drawn = smallest_digests(keys, [group], "_h", n, [key]).select(group, key)
    return df.join(drawn, [group, key], "left_semi")


def position_slice(df: DataFrame, order: str, lo: int, hi: int) -> DataFrame:
    """Rows ``lo`` to ``hi - 1`` in the order of a unique number; ``hi`` past the end is the end."""
    return rank_by_number(df, order, "idx").filter((F.col("idx") >= lo) & (F.col("idx") < hi))


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows; all of them for n <= 0."""
    return df.orderBy(order).limit(n) if n > 0 else df


def pairs_in_row(scored: DataFrame) -> DataFrame:
    """Masked pairs from ``doc_id, sents, scores``, lists of one length and not empty; chosen in the row of the document."""
    at = (F.array_position("scores", F.array_max("scores")) - 1).cast("int")
    rows = scored.select("doc_id", "sents", "scores", at.alias("at"))
    return rows.select("doc_id", F.col("at").cast("long").alias("sid"), F.get("scores", "at").alias("score"),
                       tx.masked(F.col("sents"), F.col("at")).alias("document"), F.get("sents", "at").alias("summary"))
