"""Metrics of two systems' summaries against a reference, and the comparisons built on them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from salience.functions import text as tx
from salience.functions.matching import lcs, line_hits, shared_tokens, summary_hits
from salience.functions.stemming import stemmed
from salience.functions.tdist import t_p_value
from salience.operators.scale import settled

ALPHA = 0.05
DOMINANT = 4
OVERLAP_METRICS = ["rouge1", "rouge2", "precision1", "recall1", "precision2", "recall2"]
SUMMARY_METRICS = [*OVERLAP_METRICS, "rougeL", "rougeLsum"]
HEADLINE_METRICS = ["rouge1", "rouge2", "rougeL", "rougeLsum"]
GRID = ["dataset", "checkpoint", "metric"]

# Poisson(1) weights by 16-bit draw; a draw below the k-th bound has weight k.
POISSON_BOUNDS = [24109, 48219, 60273, 64292, 65296, 65497, 65531]


def bootstrap_weights(key: object, replicates: int) -> np.ndarray:
    """Weight 1, then a Poisson(1) weight for each replicate, from digests of the key with eight draws each."""
    digests = "".join(hashlib.md5(f"boot:{key}:{k}".encode()).hexdigest() for k in range(-(-replicates // 8)))
    draws = np.frombuffer(bytes.fromhex(digests), ">u2")[:replicates]
    return np.concatenate([[1], np.searchsorted(POISSON_BOUNDS, draws, side="right")])


def shared_count(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token lists."""
    return F.aggregate(
        F.array_intersect(a, b), F.lit(0).cast("long"),
        lambda n, w: n + F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(b, lambda x: x == w))))


def _share(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def _three(both: Column, n_cand: Column, n_ref: Column, n: int) -> list[Column]:
    """F1, precision and recall of what two lists share."""
    return [
        _share(F.lit(2.0) * both, n_cand + n_ref).alias(f"rouge{n}"),
        _share(both, n_cand).alias(f"precision{n}"),
        _share(both, n_ref).alias(f"recall{n}"),
    ]


def overlap_scores(cand: Column, ref: Column, n: int) -> list[Column]:
    """F1, precision and recall of word (n=1) or word-pair (n=2) overlap of two token lists."""
    x, y = (cand, ref) if n == 1 else (tx.ngrams2(cand), tx.ngrams2(ref))
    return _three(shared_count(x, y), F.size(x), F.size(y), n)


def paired_scores(preds: DataFrame, use_stems: bool = False, keep: list[Column] | None = None) -> DataFrame:
    """``doc_id, dataset, checkpoint, metric, a, b``, all computed in the row of the pair; nothing is shuffled.

    What the summaries share with the reference is counted for many rows at once, so a long sentence costs no more a word than a
    short one.
    """
    rest = keep or []
    toks = lambda c: stemmed(tx.tokens(F.col(c))) if use_stems else tx.tokens(F.col(c))
    shared = shared_tokens(toks("reference"), toks("summary_a"), toks("summary_b"))
    rows = preds.select("doc_id", "dataset", "checkpoint", *rest, shared.alias("h"))
    extra = rows.columns[3:-1]
    size, pairs = lambda s: F.col(f"h.n{s}"), lambda s: F.greatest(F.col(f"h.n{s}") - 1, F.lit(0))
    scored = settled(rows).select(
        "doc_id", "dataset", "checkpoint", *extra,
        *[F.struct(*_three(F.col(f"h.{s}1"), size(s), size("r"), 1), *_three(F.col(f"h.{s}2"), pairs(s), pairs("r"), 2)).alias(f"s_{s}") for s in "ab"])
    each = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"s_a.{m}").alias("a"), F.col(f"s_b.{m}").alias("b")) for m in OVERLAP_METRICS]))
    return scored.select("doc_id", "dataset", "checkpoint", *extra, each.alias("x")).select("doc_id", "dataset", "checkpoint", *extra, "x.*")


def subsequence_scores(preds: DataFrame, use_stems: bool = True) -> DataFrame:
    """F1 of the longest common subsequence, both systems."""
    toks = lambda c: stemmed(tx.tokens(F.col(c))) if use_stems else tx.tokens(F.col(c))
    rows = preds.select("doc_id", "dataset", "checkpoint", toks("reference").alias("r"), toks("summary_a").alias("a"), toks("summary_b").alias("b"))
    f = lambda s: tx.r6(_share(F.lit(2.0) * lcs(F.col(s), F.col("r")), F.size(s) + F.size("r")))
    return rows.select("doc_id", "dataset", "checkpoint", F.lit("rougeL").alias("metric"), f("a").alias("a"), f("b").alias("b"))


def summary_scores(preds: DataFrame, use_stems: bool = True, keep: list[Column] | None = None) -> DataFrame:
    """``doc_id, dataset, checkpoint, metric, a, b`` for all of SUMMARY_METRICS, computed in the row of the pair.

    rougeL takes a text as one token list; rougeLsum takes it sentence by sentence and unites, for each sentence of the
    reference, its common subsequences with all sentences of the summary. The tokens of a slice are stemmed once.
    """
    lines = lambda c: F.transform(tx.sentences(F.coalesce(F.col(c), F.lit(""))), tx.tokens)
    rows = preds.select("doc_id", "dataset", "checkpoint", *(keep or []), lines("reference").alias("r"), lines("summary_a").alias("a"), lines("summary_b").alias("b"))
    names = rows.columns[:-3]
    flat = settled(rows.select(*names, summary_hits(F.col("r"), F.col("a"), F.col("b"), use_stems).alias("h"))).select(*names, "h.*")

    def scores(c: str) -> Column:
        cand, ref = F.col(f"t{c}"), F.col("tr")
        f1 = lambda hits: _share(F.lit(2.0) * F.col(hits), F.size(cand) + F.size(ref))
        return F.struct(*overlap_scores(cand, ref, 1), *overlap_scores(cand, ref, 2), f1(f"l{c}").alias("rougeL"), f1(f"u{c}").alias("rougeLsum")).alias(c)

    scored = settled(flat.select(*names, scores("a"), scores("b")))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a.{m}").alias("a"), F.col(f"b.{m}").alias("b")) for m in SUMMARY_METRICS]))
    return scored.select(*names, each.alias("x")).select(*names, "x.*")


def line_union_score(cand_text: Column, ref_text: Column) -> Column:
    """F1 of the union of line-wise common subsequences of two texts with one sentence per line."""
    lines = lambda t: F.transform(F.split(t, "\n"), tx.tokens)
    size = lambda x: F.aggregate(x, F.lit(0), lambda n, t: n + F.size(t))
    c, r = lines(cand_text), lines(ref_text)
    return tx.r6(_share(F.lit(2.0) * line_hits(r, c), size(c) + size(r)))


def long_scores(paired: DataFrame) -> DataFrame:
    """One row per system and metric."""
    return paired.unpivot(["doc_id", "dataset", "checkpoint", "metric"], ["a", "b"], "system", "score")


def better_counts(paired: DataFrame) -> DataFrame:
    return paired.groupBy("dataset", "metric").agg(
        F.count_if(F.col("a") > F.col("b")).alias("a_better"), F.count_if(F.col("a") < F.col("b")).alias("b_better"),
        F.count_if(F.col("a") == F.col("b")).alias("equal"))


def wide_signs(paired: DataFrame) -> DataFrame:
    """Per document the sign of a - b for every metric, as a map."""
    sign = F.signum(F.col("a") - F.col("b")).cast("int")
    return paired.groupBy("doc_id", "dataset", "checkpoint").agg(F.map_from_entries(F.collect_list(F.struct("metric", sign))).alias("signs"))


def both_agree(paired: DataFrame, first: str, second: str) -> DataFrame:
    """Documents on which two metrics name the same better system."""
    s = wide_signs(paired.filter(F.col("metric").isin(first, second)))
    each = lambda v: F.count_if((F.col("signs")[first] == v) & (F.col("signs")[second] == v))
    return s.groupBy("dataset").agg(each(1).alias("both_a"), each(-1).alias("both_b"))


def dominance(paired: DataFrame, verdicts: DataFrame, least: int = DOMINANT) -> DataFrame:
    """How often one system wins at least ``least`` metrics, and how often the judge says otherwise."""
    wins = paired.groupBy("doc_id", "dataset").agg(
        F.count_if(F.col("a") > F.col("b")).alias("wa"), F.count_if(F.col("a") < F.col("b")).alias("wb"))
    rows = wins.join(verdicts.select("doc_id", "winner"), "doc_id", "left")
    a, b = F.col("wa") >= least, F.col("wb") >= least
    w = F.col("winner")
    return rows.groupBy("dataset").agg(
        F.count_if(a).alias("a_dominates"), F.count_if(b).alias("b_dominates"),
        F.count_if(b & (w == "a")).alias("judge_a_metrics_b"), F.count_if(a & (w == "b")).alias("judge_b_metrics_a"),
        F.count_if(a & (w == "tie")).alias("judge_tie_metrics_a"), F.count_if(b & (w == "tie")).alias("judge_tie_metrics_b"))


def paired_t(paired: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Paired t statistic per group over documents where at least one system scores above 0."""
    keys = keys or GRID
    d = F.col("a") - F.col("b")
    stats = paired.filter((F.col("a") != 0) | (F.col("b") != 0)).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("sd"))
    t = F.when((F.col("n") > 1) & (F.col("sd") > 1e-12), F.col("m") / (F.col("sd") / F.sqrt("n")))
    return stats.select(*keys, "n", tx.r6(F.col("m")).alias("mean_diff"), tx.r6(t).alias("t")).withColumn(
        "direction", F.when(F.col("t") < 0, "LOWER").when(F.col("t") >= 0, "HIGHER"))


def with_p(tests: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Two-sided p-value and significance of each test; the table has one row per test."""
    p = F.nanvl(t_p_value(F.col("t"), (F.col("n") - 1).cast("double")), F.lit(None).cast("double"))
    return tests.withColumn("p_raw", p).withColumn("significant", F.col("p_raw") < alpha)


def mean_scores(paired: DataFrame) -> DataFrame:
    return long_scores(paired).groupBy("dataset", "checkpoint", "system", "metric").agg(
        F.count("*").alias("n"), tx.r6(F.avg("score")).alias("mean"))


def result_matrix(paired: DataFrame, metrics: list[str]) -> DataFrame:
    """Checkpoint and system as rows, metrics as columns."""
    return long_scores(paired).groupBy("dataset", "checkpoint", "system").pivot("metric", metrics).agg(tx.r6(F.avg("score")))


def corpus_metric(scores: DataFrame, keys: list[str], replicates: int = 1000) -> DataFrame:
    """Mean and bootstrap median of each metric times 100, with the mean generated length.

    ``scores`` holds ``keys, system, metric, doc_id, score, gen_len``. A resample gives each document a Poisson(1)
    weight drawn from a digest of its key, so a replicate is a weighted mean that needs no random state and no
    resampled copy. A batch of rows draws the weights of each of its documents once and leaves one sum per group and
    replicate; no row is multiplied. Replicate -1 has weight 1 throughout and yields the plain means.
    """
    groups = [*keys, "system", "metric"]

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            docs, place = np.unique(frame["doc_id"].to_numpy(), return_inverse=True)
            weights = np.array([bootstrap_weights(d, replicates) for d in docs]).reshape(len(docs), replicates + 1)
            for name, rows in frame.groupby(groups, sort=False).indices.items():
                w = weights[place[rows]].astype(float)
                out = pd.DataFrame({"rep": np.arange(-1, replicates), "s": w.T @ frame["score"].to_numpy()[rows], "n": w.sum(axis=0).astype(np.int64)})
                out["len"], out["rows"] = float(frame["gen_len"].to_numpy()[rows].sum()), len(rows)
                for column, value in zip(groups, name):
                    out[column] = value
                yield out

    names = ", ".join(f"{c} {scores.schema[c].dataType.simpleString()}" for c in groups)
    parts = scores.select(*groups, "doc_id", F.col("score").cast("double").alias("score"), "gen_len").mapInPandas(
        partial, f"rep long, s double, n long, len double, rows long, {names}")
    reps = parts.groupBy(*groups, "rep").agg(*[F.sum(c).alias(c) for c in ("s", "n", "len", "rows")])
    of_all, mean = F.col("rep") == -1, F.col("s") / F.nullif("n", F.lit(0))
    return reps.groupBy(*groups).agg(
        F.round(F.max(F.when(of_all, mean)) * 100, 4).alias("mean"), F.round(F.percentile(F.when(~of_all, mean), F.lit(0.5)) * 100, 4).alias("boot_mid"),
        F.round(F.max(F.when(of_all, F.col("len") / F.col("rows"))), 4).alias("gen_len"))


def widen(base: DataFrame, extra: DataFrame, keys: list[str], guard: str) -> DataFrame:
    """Adds the columns of ``extra`` by key; ``guard_ok`` tells whether both sides carry the same guard text."""
    e = extra.withColumnRenamed(guard, "_guard")
    return base.join(e, keys, "left").withColumn("guard_ok", F.col(guard).eqNullSafe(F.col("_guard"))).drop("_guard")


def duplicate_tests(tests: DataFrame) -> DataFrame:
    """Tests whose (dataset, metric, checkpoint) occurs more than once."""
    keys = ["dataset", "metric", "checkpoint"]
    return tests.withColumn("copies", F.count("*").over(W.partitionBy(*keys))).filter("copies > 1")
