"""Documents to sentences and token counts.

A document is one row, and everything that belongs to it is computed in that row; nothing here shuffles text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salience.functions import documents as dc
from salience.functions import text as tx


def sentence_rows(docs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row per sentence with its document key; purely row-wise, no shuffle."""
    return docs.select("doc_id", *(extra or []), F.posexplode(tx.sentences(F.col("text"))).alias("sid", "sent")).withColumn(
        "sid", F.col("sid").cast("long"))


def token_lists(docs: DataFrame) -> DataFrame:
    """``doc_id, lists``: the tokens of each sentence."""
    return docs.select("doc_id", F.transform(tx.sentences(F.col("text")), tx.tokens).alias("lists"))


def sentence_words(docs: DataFrame) -> DataFrame:
    """``doc_id, n_doc, sid, n_sent, overlap, w, c, c_doc`` per distinct word of a sentence; narrow.

    A sentence without tokens has one row without a word. ``overlap`` is what the sentence shares with the others.
    """
    counted = token_lists(docs).select("doc_id", F.explode(dc.word_counts("lists")).alias("x"))
    return counted.select("doc_id", *[F.col(f"x.{c}").alias(c) for c in ("n_doc", "sid", "n_sent", "overlap", "w", "c", "c_doc")])


def token_counts(docs: DataFrame) -> DataFrame:
    """``doc_id, sid, w, n_sent, n_doc, c, c_doc``: counts of each word in its sentence and its document; narrow."""
    return sentence_words(docs).filter("w IS NOT NULL").drop("overlap")


def corpus_counts(docs: DataFrame) -> DataFrame:
    """``w, c_all``. Counted map-side first; worth writing to a table when several jobs use one corpus.

    Joins on ``w`` add a null filter; having it here as well makes all uses in a query the same exchange.
    """
    words = docs.select(F.explode(tx.tokens(F.col("text"))).alias("w")).filter(F.col("w").isNotNull())
    return words.groupBy("w").agg(F.count("*").alias("c_all"))
