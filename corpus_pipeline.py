"""From raw documents to packed training sequences: quality, line dedup, near copies, source mix, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written and read again as the next one's documents. All
but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salience.llm import jaccard, lines, mixing, packing, quality
from salience.llm.graph import stored
from salience.session import scratch_path, ship

#: SQL cannot express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None
KEEP = 0.7


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; texts without words get the share of good labels as their score."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    model = quality.fit(docs, labels)
    return docs.filter(quality.score_of(docs, model, F.col("text")) >= KEEP)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat earlier ones go, however short, and with them documents of which nothing else is left.

    Rows of equal id and text are one document here; null and empty texts stay.
    """
    left = lines.dedup_lines(docs, drop_emptied=True, short=True)
    return left.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that with the smallest id, nulls last.

    Decided row by row: repeated ids and null ids are rows like others. Rows without words are copies of nothing. Rows are
    known by their place in the scan, which is the same in every reading of a written table.
    """
    placed = docs.withColumn("_row", F.monotonically_increasing_id())
    linked = jaccard.link(placed, id_col="_row").filter("n_shingles > 0")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    groups = linked.groupBy("component_id").agg(F.count("*").alias("n")).filter("n > 1").select("component_id")
    members = linked.join(groups, "component_id").join(placed.select("_row", "doc_id"), "_row").select("component_id", "_row", first.alias("first"))
    members = stored(members, "members")
    kept = members.groupBy("component_id").agg(F.min("first")["_row"].alias("_row"))
    copies = members.join(kept.select("_row"), "_row", "left_anti").select("_row")
    return placed.join(copies, "_row", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in token sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", classify), ("line_dedup", drop_lines), ("near_copies", drop_copies), ("mixing", mix_sources), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
