"""Win rates with the length difference of the two summaries held constant.

Everything after the first step works on a histogram, one row per dataset, checkpoint and length difference with its
counts. That step combines map-side, so the largest dataset costs no more than its number of distinct differences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from salience.functions.moments import correlation
from salience.functions.text import percent, r6

Z = 1.96

# Number of quantile bins, least pairs per bin, open ends, t(6, 0.975), and the display bins.
TARGET_BINS = 20
LEAST_IN_BIN = 30
OPEN = 10**9
T_6 = 2.447
DISPLAY_BINS = [(-OPEN, -10), (-9, -5), (-4, -2), (-1, 1), (2, 4), (5, 9), (10, OPEN)]
DISPLAY_NAMES = ["10+ shorter", "5-9 shorter", "2-4 shorter", "within 1", "2-4 longer", "5-9 longer", "10+ longer"]


def histogram(pairs: DataFrame) -> DataFrame:
    """From ``dataset, checkpoint, words_a, words_b, winner``: counts per length difference."""
    return pairs.withColumn("delta", (F.col("words_a") - F.col("words_b")).cast("long")).groupBy("dataset", "checkpoint", "delta").agg(
        F.count("*").alias("n_all"), F.count_if(F.col("winner").isin("a", "b")).alias("n"),
        F.count_if(F.col("winner") == "a").alias("wins"), F.count_if(F.col("winner") == "tie").alias("ties"),
        F.sum("words_a").alias("words_a"), F.sum("words_b").alias("words_b"))


def quantile_bins(hist: DataFrame, target: int = TARGET_BINS, least: int = LEAST_IN_BIN) -> DataFrame:
    """``dataset, j, lo, hi, label, weight``: bins at exact quantile ranks, small ones merged into the next.

    A value that spans several quantiles gets one bin. The last small bin joins the one before it. Each dataset has
    at most ``target`` bins, so the merge is a fold over one short array.
    """
    values = hist.groupBy("dataset", "delta").agg(F.sum("n_all").alias("c"))
    upto = W.partitionBy("dataset").orderBy("delta")
    ranked = values.select("dataset", "delta", "c", F.sum("c").over(upto).alias("cum"), F.sum("c").over(W.partitionBy("dataset")).alias("n"))
    rank = lambda k: F.least(F.floor(F.col("n") * k / target), F.col("n") - 1)
    hit = F.exists(F.sequence(F.lit(1), F.lit(target - 1)), lambda k: (rank(k) >= F.col("cum") - F.col("c")) & (rank(k) < F.col("cum")))
    numbered = ranked.withColumn("cut", hit.cast("long")).withColumn("k", F.sum("cut").over(upto))
    raw = numbered.groupBy("dataset", "k").agg(F.min("delta").alias("lo"), F.sum("c").alias("c"))
    per = raw.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("k", "lo", "c"))).alias("bins"))
    bin_t = "struct<lo:bigint,c:bigint>"
    start = F.struct(F.array().cast(f"array<{bin_t}>").alias("done"), F.lit(None).cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("c"))

    def merge(acc: Column, b: Column) -> Column:
        lo, c = F.coalesce(acc["lo"], b["lo"]), acc["c"] + b["c"]
        full = c >= least
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.struct(lo.alias("lo"), c.alias("c"))))).otherwise(acc["done"]).alias("done"),
            F.when(~full, lo).alias("lo"), F.when(full, F.lit(0).cast("bigint")).otherwise(c).alias("c"))

    def close(acc: Column) -> Column:
        rest = acc["lo"].isNotNull()
        only = F.array(F.struct(acc["lo"].alias("lo"), acc["c"].alias("c")))
        last = F.element_at(acc["done"], -1)
        grown = F.concat(F.slice(acc["done"], F.lit(1), F.size(acc["done"]) - 1),
                         F.array(F.struct(last["lo"].alias("lo"), (last["c"] + acc["c"]).alias("c"))))
        return F.when(~rest, acc["done"]).when(F.size(acc["done"]) == 0, only).otherwise(grown)

    merged = per.select("dataset", F.aggregate("bins", start, merge, close).alias("m"))
    flat = merged.select("dataset", "m", F.posexplode("m").alias("j", "b"))
    lo = F.when(F.col("j") == 0, F.lit(-OPEN)).otherwise(F.col("b.lo")).cast("long")
    hi = F.coalesce(F.get("m", F.col("j") + 1)["lo"] - 1, F.lit(OPEN)).cast("long")
    text = F.when(lo == hi, lo.cast("string")).otherwise(F.concat(
        F.when(lo == -OPEN, "<=").otherwise(lo.cast("string")), F.lit(".."), F.when(hi == OPEN, "+").otherwise(hi.cast("string"))))
    return flat.select("dataset", F.col("j").cast("long").alias("j"), lo.alias("lo"), hi.alias("hi"), text.alias("label"), F.col("b.c").alias("weight"))


def raw_rates(hist: DataFrame) -> DataFrame:
    """Win rate among decided pairs, its variance, ties, and the mean length ratio per checkpoint."""
    s = hist.groupBy("dataset", "checkpoint").agg(*[F.sum(c).alias(c) for c in ("n_all", "n", "wins", "ties", "words_a", "words_b")])
    p = F.col("wins") / F.nullif("n", F.lit(0))
    return s.select("dataset", "checkpoint", "n", "ties", F.col("n_all").alias("total"), p.alias("rate"),
                    (p * (1 - p) / F.nullif("n", F.lit(0))).alias("var"), (F.col("words_a") / F.nullif("words_b", F.lit(0))).alias("ratio"))


def standardized_rates(hist: DataFrame, bins: DataFrame, least: int = LEAST_IN_BIN) -> DataFrame:
    """Each checkpoint's rate against the dataset's pooled mix of length differences.

    Bins with too few decided pairs in a checkpoint drop out and the remaining weights are scaled up.
    """
    met = hist.join(bins.select("dataset", "j", "lo", "hi", "weight"), "dataset").filter((F.col("delta") >= F.col("lo")) & (F.col("delta") <= F.col("hi")))
    cells = met.groupBy("dataset", "checkpoint", "j").agg(F.sum("n").alias("n"), F.sum("wins").alias("wins"), F.max("weight").alias("w")).filter(F.col("n") >= least)
    whole = F.sum("w").over(W.partitionBy("dataset", "checkpoint"))
    share = cells.withColumn("w", F.col("w") / whole).withColumn("p", F.col("wins") / F.col("n"))
    return share.groupBy("dataset", "checkpoint").agg(
        F.sum(F.col("w") * F.col("p")).alias("rate"), F.sum(F.col("w") * F.col("w") * F.col("p") * (1 - F.col("p")) / F.col("n")).alias("var"))


def display_bin(delta: Column) -> Column:
    out = F.lit(None).cast("string")
    for (lo, hi), name in zip(DISPLAY_BINS, DISPLAY_NAMES):
        out = F.when((delta >= lo) & (delta <= hi), name).otherwise(out)
    return out


def length_bias(hist: DataFrame) -> DataFrame:
    """Win rate by display bin over all checkpoints; bins without decided pairs are left out."""
    s = hist.groupBy("dataset", display_bin(F.col("delta")).alias("bin")).agg(F.sum("n").alias("n"), F.sum("wins").alias("wins"))
    return s.filter("n > 0").select("dataset", "bin", "n", r6(F.col("wins") / F.col("n")).alias("rate"))


def length_mix(hist: DataFrame) -> DataFrame:
    """Share of decided pairs in each display bin, one row per checkpoint."""
    s = hist.withColumn("bin", display_bin(F.col("delta"))).groupBy("dataset", "checkpoint").pivot("bin", DISPLAY_NAMES).agg(F.sum("n"))
    whole = hist.groupBy("dataset", "checkpoint").agg(F.sum("n").alias("n")).filter("n > 0")
    return whole.join(s, ["dataset", "checkpoint"]).select(
        "dataset", "checkpoint", "n", *[r6(percent(F.coalesce(F.col(f"`{b}`"), F.lit(0)), F.col("n"))).alias(f"bin_{i}") for i, b in enumerate(DISPLAY_NAMES)])


def first_to_last(rates: DataFrame) -> DataFrame:
    """Change from the first to the last checkpoint in points, with its interval; ``step`` orders checkpoints."""
    known = rates.filter(F.col("rate").isNotNull())
    ends = known.groupBy("dataset").agg(
        F.count("*").alias("n"), *[f(c, "step").alias(f"{c}_{e}") for e, f in (("first", F.min_by), ("last", F.max_by)) for c in ("rate", "var")])
    d = (F.col("rate_last") - F.col("rate_first")) * 100
    ci = Z * F.sqrt(F.col("var_first") + F.col("var_last")) * 100
    return ends.filter("n >= 2").select("dataset", r6(d).alias("change"), r6(ci).alias("half_ci"), (F.abs(d) > ci).alias("significant"))


def trend(rates: DataFrame) -> DataFrame:
    """Least-squares slope of the rate in points per step."""
    y, x = F.col("rate") * 100, F.col("step").cast("double")
    s = rates.filter(F.col("rate").isNotNull()).groupBy("dataset").agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy"))
    rest = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    se = F.sqrt(rest / (F.col("n") - 2) / F.col("sxx"))
    # without different steps there is no slope
    return s.filter("n >= 3 AND sxx > 0").select("dataset", "n", r6(F.col("slope")).alias("slope"), r6(F.col("intercept")).alias("intercept"),
                                     r6(T_6 * se).alias("half_ci"), (F.abs("slope") > T_6 * se).alias("significant"))


def residual_check(raw: DataFrame, standardized: DataFrame) -> DataFrame:
    """Correlation of length ratio and win rate, before and after; 0 where it is undefined."""
    both = raw.select("dataset", "checkpoint", "ratio", F.col("rate").alias("raw")).join(
        standardized.select("dataset", "checkpoint", F.col("rate").alias("std")), ["dataset", "checkpoint"])
    return both.groupBy("dataset").agg(
        F.count("*").alias("n"), r6(F.coalesce(correlation(F.col("ratio"), F.col("raw")), F.lit(0.0))).alias("raw_r"),
        r6(F.coalesce(correlation(F.col("ratio"), F.col("std")), F.lit(0.0))).alias("std_r")).filter("n >= 3")


def judge_agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Correlation of two judges' rates over the checkpoints both have."""
    both = first.select("dataset", "checkpoint", F.col("rate").alias("x")).join(
        second.select("dataset", "checkpoint", F.col("rate").alias("y")), ["dataset", "checkpoint"])
    return both.groupBy("dataset").agg(F.count("*").alias("n"), r6(correlation(F.col("x"), F.col("y"))).alias("r")).filter("n >= 3")
