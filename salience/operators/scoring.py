"""Scores of each sentence against the rest of its document."""

from __future__ import annotations

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salience.functions import text as tx
from salience.functions import documents as dc
from salience.functions.matching import lcs_with_rest
from salience.operators.scale import heavy_keys, in_few_files, written
from salience.operators.sentences import corpus_counts, token_lists

SMOOTHING = 64.0
HEAVY_WORDS = 100_000
HASH_BUCKETS = dc.HASH_BUCKETS


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, F.lit(2.0) * top / bottom).otherwise(F.lit(0.0))


def _per_sentence(docs: DataFrame, scored) -> DataFrame:
    """``doc_id, n_doc, sid, n_sent, value``: the elements of a struct computed from ``lists`` in one step; narrow."""
    found = token_lists(docs).select("doc_id", scored("lists").alias("x"))
    rows = found.select("doc_id", F.col("x.n_doc").alias("n_doc"), F.posexplode(F.arrays_zip("x.n_sent", "x.scores")).alias("sid", "s"))
    return rows.select("doc_id", "n_doc", F.col("sid").cast("long").alias("sid"), F.col("s.n_sent").alias("n_sent"), F.col("s.scores").alias("value"))


def rouge1(docs: DataFrame) -> DataFrame:
    """F1 of shared words between a sentence and the others: ``2 * shared / words in the document``; narrow."""
    rows = _per_sentence(docs, dc.word_overlaps).withColumnRenamed("value", "overlap")
    return rows.select("doc_id", "sid", "overlap", "n_doc", tx.r6(_ratio(F.col("overlap"), F.col("n_doc"))).alias("score"))


def rouge1_list(docs: DataFrame) -> DataFrame:
    """``doc_id, sents, scores``: the same as an array in the row of the document, for choices that need no join.

    Documents without sentences go here, before anything is scored: a filter on the scores would carry the scoring along.
    """
    rows = docs.select("doc_id", tx.sentences(F.col("text")).alias("sents")).filter(F.size("sents") > 0)
    scored = rows.select("doc_id", "sents", dc.word_overlaps(F.transform("sents", tx.tokens)).alias("x"))
    return scored.select("doc_id", "sents", F.transform("x.scores", lambda o: tx.r6(_ratio(o, F.col("x.n_doc")))).alias("scores"))


def rouge2(docs: DataFrame) -> DataFrame:
    """The same on word pairs.

    Taking a sentence out of the text removes its own pairs and the pairs at its two borders, and makes one new
    pair where the neighbours meet; only the counts of the sentence's own pairs matter for the overlap.
    """
    rows = _per_sentence(docs, dc.pair_overlaps).withColumnRenamed("value", "overlap")
    n_pairs = F.greatest(F.col("n_sent") - 1, F.lit(0)) + F.greatest(F.col("n_doc") - F.col("n_sent") - 1, F.lit(0))
    return rows.select("doc_id", "sid", "overlap", tx.r6(_ratio(F.col("overlap"), n_pairs)).alias("score"))


def rouge_l(docs: DataFrame) -> DataFrame:
    """Longest common subsequence of a sentence and the others; one Arrow pass over whole documents."""
    rows = _per_sentence(docs, lcs_with_rest).withColumnRenamed("value", "lcs")
    return rows.select("doc_id", "sid", "lcs", tx.r6(_ratio(F.col("lcs"), F.col("n_doc"))).alias("score"))


def _word_term(total: Column, kinds: Column, mu: float) -> Column:
    """Bits by which the rest of the document makes a word likelier than the corpus does, times its count."""
    p0 = (F.col("c_all") + 1.0) / (total + kinds)
    pc = ((F.col("c_doc") - F.col("c")) + F.lit(mu) * p0) / (F.col("n_doc") - F.col("n_sent") + F.lit(mu))
    return F.col("c") * F.log2(pc / p0)


def overlap_and_pmi(docs: DataFrame, vocabulary: DataFrame | None = None, mu: float = SMOOTHING) -> DataFrame:
    """``doc_id, sid, rouge1, pmi`` from one pass over the token counts; partitioned by ``doc_id``.

    PMI is the mean over the sentence's words of log2 P(word given the rest) / P(word), both from counts:
    the rest is smoothed towards the corpus. Words that hold over 1/100000 of the corpus, at most 100000 of them,
    are sent to all tasks and counted in the row of the document, and so are words that one sentence has alone, whose corpus
    counts cancel out. The rare words that sentences of a document share travel as rows; only those are joined by a shuffle, and
    none of them is frequent. Sentences go to a scratch table, which both the join and the sums read. Tasks that split and score texts
    write no files: what they found is shuffled first and written by few tasks.
    """
    whole = vocabulary is None
    vocabulary = written(in_few_files(corpus_counts(docs)), "vocabulary") if whole else vocabulary
    total = vocabulary.select(F.sum("c_all")).scalar()
    kinds = vocabulary.select(F.count("*")).scalar()
    heavy = heavy_keys(vocabulary, "c_all", HEAVY_WORDS)
    known, size = frequent(vocabulary, heavy)
    found = token_lists(docs).select("doc_id", F.explode(dc.sentence_bits("lists", known, size, mu, whole)).alias("x"))
    sents = written(in_few_files(found.select("doc_id", "x.*").repartition("doc_id")), "sentences")
    own = ["doc_id", "sid", "n_doc", "n_sent", "overlap"]
    words = sents.filter(F.size("rare") > 0).select(*own, F.explode("rare").alias("r")).select(*own, "r.*")
    shared = words.join(vocabulary.filter(~heavy), "w").select(*own, F.lit(0.0).alias("near_bits"), _word_term(total, kinds, mu).alias("far_bits"))
    sums = (
        sents.select(*own, "near_bits", "far_bits").unionByName(shared).repartition("doc_id")
        .groupBy(*own).agg(F.sum("near_bits").alias("near_bits"), F.sum("far_bits").alias("far_bits"))
        .groupBy("doc_id", "sid")
        .agg(F.max("n_doc").alias("n_doc"), F.max("n_sent").alias("n_sent"), F.max("overlap").alias("overlap"),
             F.max("near_bits").alias("near_bits"), F.sum("far_bits").alias("far_bits"))
    )
    alone = (F.col("n_doc") == F.col("n_sent")) | (F.col("n_sent") == 0)
    return sums.select(
        "doc_id", "sid",
        tx.r6(_ratio(F.col("overlap"), F.col("n_doc"))).alias("rouge1"),
        tx.r6(F.when(alone, F.lit(0.0)).otherwise((F.col("near_bits") + F.col("far_bits")) / F.greatest(F.col("n_sent"), F.lit(1)))).alias("pmi"))


def frequent(vocabulary: DataFrame, heavy: Column) -> tuple[Broadcast, float]:
    """The heavy words, at most 100000, with their counts as a broadcast for tasks in Python, and the corpus in tokens and kinds."""
    found = vocabulary.filter(heavy & F.col("w").isNotNull()).toArrow()
    tokens, kinds = vocabulary.agg(F.coalesce(F.sum("c_all"), F.lit(0)), F.count("*")).first()
    table = (found["w"].combine_chunks().cast("string"), found["c_all"].to_numpy().astype(float))
    return vocabulary.sparkSession.sparkContext.broadcast(table), float(tokens + kinds)


def count_pmi(docs: DataFrame, vocabulary: DataFrame | None = None, mu: float = SMOOTHING) -> DataFrame:
    return overlap_and_pmi(docs, vocabulary, mu).select("doc_id", "sid", F.col("pmi").alias("score"))


def likelihood_pmi(nll: DataFrame) -> DataFrame:
    """PMI from token log-likelihoods made by any model: ``doc_id, sid, kind (cond/marg), pos, nll``.

    Each sequence gives exp(-mean nll); the score is log2 of their ratio, taken as a difference so that long or
    unlikely sequences do not underflow.
    """
    mean = lambda kind: F.avg(F.when(F.col("kind") == kind, F.col("nll")))
    return (
        nll.groupBy("doc_id", "sid").agg(mean("cond").alias("cond"), mean("marg").alias("marg"))
        .select("doc_id", "sid", tx.r6(F.exp(-F.col("cond"))).alias("p_cond"), tx.r6(F.exp(-F.col("marg"))).alias("p_marg"),
                tx.r6((F.col("marg") - F.col("cond")) / F.log(F.lit(2.0))).alias("score"))
    )


def baseline_pmi(nll: DataFrame, per_token: bool = True) -> DataFrame:
    """log2 P(sentence given the rest) - log2 P(sentence given a fixed prompt), per token or in total."""
    fold = F.avg if per_token else F.sum
    part = lambda kind: fold(F.when(F.col("kind") == kind, F.col("nll")))
    return (
        nll.groupBy("doc_id", "sid").agg(part("cond").alias("cond"), part("base").alias("base"))
        .select("doc_id", "sid", tx.r6((F.col("base") - F.col("cond")) / F.log(F.lit(2.0))).alias("score"))
    )


def hashed_context_similarity(docs: DataFrame, buckets: int = HASH_BUCKETS) -> DataFrame:
    """Cosine of a sentence and its leave-one-out text under a hashed word-count encoder; narrow.

    The encoder is linear, so the encoding of the rest is the document's minus the sentence's and no
    leave-one-out text is ever written out. A single sentence scores 0.
    """
    rows = _per_sentence(docs, lambda lists: dc.context_cosines(lists, buckets))
    return rows.select("doc_id", "sid", tx.r6(F.col("value")).alias("score"))
