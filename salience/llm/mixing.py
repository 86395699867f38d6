"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every source has a target number of words. A document's expected copies are its source's target over the source's words.
Inside a source the documents stand in order of size, their expected copies are summed up, one offset drawn per source is
added, and a document is taken once for each whole number that its stretch of the running sum crosses. Since neighbours
in that order are of like size, the words taken stay within about one document of the target.

The order is by size and then id at any scale, but no task sees a whole source: counts per (source, size, slice) give every
slice its first rank. A (source, size) with over ``SLICE`` rows and over 1/``MOST`` of all rows is cut at approximate quantiles of
the id into ``CUTS`` + 1 slices, which stand in the order of the ids, so no slice is hot and ranks are the same wherever the
cuts fall. At most ``MOST`` such keys exist, which bounds what is broadcast.

Null text has size 0; a null source is a source of its own and the last in order. In a source without words every
document is taken once, which adds nothing. Equal rows are interchangeable. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salience.llm.graph import stored

WEIGHTS = (5, 2, 1)
CAP = 3
SLICE = 50_000
MOST = 1024
CUTS = 255
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """From one row (source, source_size) per source: also target and copies.

    A target is the smaller of ``cap`` times the size and a level times the weight, with one level for all at which the
    targets add up to all words: there resharing the excess ends. In the order of cap over weight the stopped sources come
    first; the level is what they leave, over the weight of the others, at the first source that it does not stop.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * cap)
    ranked = ranked.withColumn("ratio", F.col("most") / F.col("weight")).withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    target = F.least(F.col("most").cast("double"), level * F.col("weight"))
    return ranked.withColumn("target", target).select(
        "source", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0)).alias("copies"))


def offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) drawn for the source."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source and size: all that the mix depends on."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """The rows, which have doc_id, source and size, with source_size, target and times.

    ``rows`` is read twice, for the counts and for the ranks; further columns travel along. Column names that start with
    ``_mix`` are taken.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    keyed = rows.withColumn("_mix_key", key)
    counts = stored(keyed.groupBy("_mix_key", "source", "size").agg(F.count("*").alias("n")), "counts")
    plan = targets(counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, cap).select(
        key.alias("_mix_key"), "source_size", "target", "copies", offset(F.col("source"), seed).alias("_mix_offset"))
    total = counts.select(F.sum("n")).scalar()
    hot = counts.filter((F.col("n") > SLICE) & (F.col("n") * MOST > total)).select("_mix_key", "size")
    if hot.isEmpty():
        dealt = keyed.withColumn("_mix_slice", F.lit(0))
    else:
        shares = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
        cuts = keyed.select("_mix_key", "size", "doc_id").join(F.broadcast(hot), ["_mix_key", "size"], "left_semi").groupBy("_mix_key", "size").agg(
            F.percentile_approx("doc_id", shares, 10 * (CUTS + 1)).alias("_mix_cuts"))
        below = F.size(F.filter("_mix_cuts", lambda c: c < F.col("doc_id")))
        dealt = keyed.join(F.broadcast(stored(cuts, "cuts")), ["_mix_key", "size"], "left").withColumn(
            "_mix_slice", F.when(F.col("_mix_cuts").isNull() | F.col("doc_id").isNull(), 0).otherwise(below)).drop("_mix_cuts")
    at = ["_mix_key", "size", "_mix_slice"]
    before = W.partitionBy("_mix_key").orderBy("size", "_mix_slice").rowsBetween(W.unboundedPreceding, -1)
    firsts = dealt.groupBy(*at).agg(F.count("*").alias("n")).withColumn("_mix_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.col("_mix_before") + F.row_number().over(W.partitionBy(*at).orderBy("doc_id"))
    ranked = dealt.join(firsts.join(plan, "_mix_key"), at).withColumn("_mix_rank", rank)
    crossed = lambda r: F.floor(F.col("copies") * r + F.col("_mix_offset"))
    times = crossed(F.col("_mix_rank")) - crossed(F.col("_mix_rank") - 1)
    # rounding of long sums must not take a document once more than its expected copies allow
    times = F.least(times, F.ceil(F.col("copies"))).cast("long")
    return ranked.withColumn("times", times).drop("_mix_key", "_mix_slice", "_mix_before", "_mix_rank", "_mix_offset", "copies")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """The documents as often as the mix takes them, with their own columns."""
    own = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_mix_row")).select(
        F.col("_mix_row.doc_id").alias("doc_id"), F.col("_mix_row.source").alias("source"),
        word_count(F.col("_mix_row.text")).alias("size"), "_mix_row")
    taken = mix(rows, weights, cap, seed).filter("times > 0")
    return taken.select("_mix_row", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("_mix_row.*")
