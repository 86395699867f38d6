"""Pairwise judging: running a judge, combining two orders, and the tables on verdicts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salience.functions import text as tx
from salience.functions import verdict as vd
from salience.operators.scale import settled

Z = 1.96
EXPECTED_OUTPUT_TOKENS = 209


def rule_completion(reference: Column, slot_a: Column, slot_b: Column, bonus: int = 1, margin: int = 1) -> Column:
    """A judge by rule, in the output form of a model: words shared with the reference decide.

    ``bonus`` favours slot A as models do, and a lead up to ``margin`` is a tie. The verdict does not depend on lengths.
    """
    kinds = lambda x: F.array_distinct(tx.tokens(x))
    shared = lambda x: F.size(F.array_intersect(kinds(x), kinds(reference)))
    a, b = shared(slot_a), shared(slot_b)
    lead = a + bonus - b
    pick = F.when(lead > margin, "A").when(lead < -margin, "B").otherwise("TIE")
    return F.concat(F.lit("Feedback: A shares "), a.cast("string"), F.lit(" words and B shares "), b.cast("string"),
                    F.lit(" with the reference. [RESULT] "), pick)


def run_judge(prompts: DataFrame, keys: list[str], make_judge: Callable[[], Callable[[list[str]], list[str]]], batch: int = 32) -> DataFrame:
    """Sends ``prompt`` in batches to any judge; a failing call fails the task, it never becomes a tie."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = None
        for frame in frames:
            judge = judge or make_judge()
            for lo in range(0, len(frame), batch):
                part = frame.iloc[lo:lo + batch]
                yield part[keys].assign(completion=judge(part["prompt"].tolist()))

    schema = T.StructType([prompts.schema[k] for k in keys] + [T.StructField("completion", T.StringType())])
    return prompts.select(*keys, "prompt").mapInPandas(run, schema)


def one_order(preds: DataFrame, style: Column | None = None, **rule) -> DataFrame:
    """Each pair judged once, slots assigned by an even, repeatable split."""
    rows = preds.withColumn("a_first", vd.a_in_first_slot(F.col("dataset"), F.col("checkpoint"), F.col("doc_id")))
    a, b = F.col("summary_a"), F.col("summary_b")
    slot_a, slot_b = vd.slot_texts(a, b, F.col("a_first"))
    said = settled(rows.withColumn("completion", rule_completion(F.col("reference"), slot_a, slot_b, **rule)).withColumn(
        "prompt", vd.judge_prompt(style if style is not None else F.lit("news"), F.col("reference"), a, b, F.col("a_first"))))
    return said.withColumn("raw_result", vd.raw_result(F.col("completion"))).withColumn(
        "winner", vd.winner(F.col("raw_result"), F.col("a_first"))).withColumn("feedback", vd.feedback(F.col("completion")))


def both_orders(preds: DataFrame, style: Column | None = None, **rule) -> DataFrame:
    """Each pair judged in both orders in one row; a verdict that does not survive the swap is a tie."""
    ref, a, b = F.col("reference"), F.col("summary_a"), F.col("summary_b")
    st = style if style is not None else F.lit("news")
    said = settled(preds.withColumn("c1", rule_completion(ref, a, b, **rule)).withColumn("c2", rule_completion(ref, b, a, **rule)))
    read = said.withColumn("raw_a_as_A", vd.raw_result(F.col("c1"))).withColumn("raw_a_as_B", vd.raw_result(F.col("c2")))
    won = read.withColumn("winner_a_as_A", vd.winner(F.col("raw_a_as_A"), F.lit(True))).withColumn(
        "winner_a_as_B", vd.winner(F.col("raw_a_as_B"), F.lit(False)))
    agree = F.col("winner_a_as_A") == F.col("winner_a_as_B")
    prompt = vd.judge_prompt(st, ref, a, b, F.lit(True))
    return won.withColumn("orders_agree", agree).withColumn(
        "winner", F.when(agree, F.col("winner_a_as_A")).otherwise("tie")).withColumn(
        "input_tokens", F.lit(2) * tx.token_estimate(prompt)).withColumn(
        "output_tokens", tx.token_estimate(F.col("c1")) + tx.token_estimate(F.col("c2"))).drop("c1", "c2")


def with_cost(rows: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Adds ``cost_usd``; models missing from the rate card cost nothing.

    The card has one short row per model, is given by the caller as a constant list, and is the only thing broadcast.
    """
    card = F.broadcast(prices.select(F.col("model").alias(model), F.col("input").alias("_in"), F.col("output").alias("_out")))
    return rows.join(card, model, "left").withColumn(
        "cost_usd", vd.call_price(F.col("input_tokens"), F.col("output_tokens"), F.col("_in"), F.col("_out"))).drop("_in", "_out")


def _of(value: str, column: str = "winner") -> Column:
    return F.count_if(F.col(column) == value)


def _pct(n: str) -> Column:
    return tx.r6(tx.percent(F.col(n), F.col("n"))).alias(f"{n}_pct")


def verdict_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and shares of verdicts, and how many completions had no tag."""
    c = rows.groupBy(*keys).agg(F.count("*").alias("n"), _of("a").alias("a"), _of("b").alias("b"), _of("tie").alias("tie"),
                                _of(vd.NO_TAG, "raw_result").alias("no_tag"))
    return c.select(*keys, "n", "a", "b", "tie", "no_tag", _pct("a"), _pct("b"), _pct("tie"), _pct("no_tag"))


def checkpoint_summary(rows: DataFrame, checkpoints: list[str], datasets: list[str]) -> DataFrame:
    """One row per dataset and known checkpoint; those without judgements are marked as not run."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(d, c) for d in datasets for c in checkpoints], "dataset STRING, checkpoint STRING")
    counts = rows.groupBy("dataset", "checkpoint").agg(F.count("*").alias("n"), _of("a").alias("a"), _of("b").alias("b"), _of("tie").alias("tie"))
    return grid.join(counts, ["dataset", "checkpoint"], "left").select(
        "dataset", "checkpoint", F.when(F.col("n").isNull(), "not run").otherwise("done").alias("state"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "a", "b", "tie")])


def consensus_stats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Win rate of system a over pairs both orders agree on, and how much the slot mattered.

    All rates are NULL where no pair was decided.
    """
    w, x, y = "winner", "winner_a_as_A", "winner_a_as_B"
    c = rows.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if("orders_agree").alias("agreed"),
        F.count_if(F.col("orders_agree") & (F.col(w) == "tie")).alias("both_tie"),
        _of("a", w).alias("_aw"), _of("b", w).alias("_bw"), _of("a", x).alias("_ax"), _of("b", x).alias("_bx"),
        _of("a", y).alias("_ay"), _of("b", y).alias("_by"))
    n, nx, ny = F.col("_aw") + F.col("_bw"), F.col("_ax") + F.col("_bx"), F.col("_ay") + F.col("_by")
    ok = (n > 0) & (nx > 0) & (ny > 0)
    p, px, py = F.col("_aw") / F.nullif(n, F.lit(0)), F.col("_ax") / F.nullif(nx, F.lit(0)), F.col("_ay") / F.nullif(ny, F.lit(0))
    spread = px * (1 - px) / F.nullif(nx, F.lit(0)) + py * (1 - py) / F.nullif(ny, F.lit(0))
    only = lambda v: tx.r6(F.when(ok, v))
    return c.select(
        *keys, "total", "agreed", (F.col("total") - F.col("agreed")).alias("disagreed"), "both_tie", n.alias("decided"),
        only(p).alias("rate"), only(Z * F.sqrt(p * (1 - p) / F.nullif(n, F.lit(0)))).alias("half_ci"), only(1 - p).alias("rate_b_system"),
        only(F.col("agreed") / F.col("total")).alias("agree_share"), only(px).alias("rate_slot_a"), only(py).alias("rate_slot_b"),
        nx.alias("n_slot_a"), ny.alias("n_slot_b"), only(px - py).alias("advantage"), only(Z * F.sqrt(spread)).alias("advantage_half_ci"))


def raw_orders(rows: DataFrame) -> DataFrame:
    """The two orders as separate tables: counts, shares and the rate among decided pairs."""
    each = rows.unpivot(["dataset", "checkpoint"], ["winner_a_as_A", "winner_a_as_B"], "slot", "w")
    c = each.groupBy("dataset", "checkpoint", F.right("slot", F.lit(1)).alias("slot")).agg(
        F.count("*").alias("n"), _of("a", "w").alias("a"), _of("b", "w").alias("b"), _of("tie", "w").alias("tie"))
    decided = F.col("a") + F.col("b")
    return c.filter(decided > 0).select("dataset", "checkpoint", "slot", "n", "a", "b", "tie", _pct("a"), _pct("b"), _pct("tie"),
                                        tx.r6(tx.percent(F.col("a"), decided)).alias("a_of_decided"))


def cost_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count("*").alias("pairs"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        tx.r6(F.sum("cost_usd")).alias("cost_usd"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))


def estimate_cost(preds: DataFrame, prices: DataFrame, model: str, style: Column, keys: list[str]) -> DataFrame:
    """Tokens and price of judging every pair in both orders, before any call."""
    prompt = vd.judge_prompt(style, F.col("reference"), F.col("summary_a"), F.col("summary_b"), F.lit(True))
    sums = preds.groupBy(*keys).agg(F.count("*").alias("pairs"), F.sum(F.lit(2) * tx.token_estimate(prompt)).alias("input_tokens"))
    full = sums.withColumn("calls", F.col("pairs") * 2).withColumn("output_tokens", F.col("calls") * EXPECTED_OUTPUT_TOKENS).withColumn("model", F.lit(model))
    return with_cost(full, prices).withColumn("cost_usd", tx.r6(F.col("cost_usd")))


def settings_seen(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of run settings, to spot runs that must not be pooled."""
    return rows.select(*columns).distinct()


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key has no result yet; results may come in any order and with gaps."""
    return work.join(done.select(*keys), keys, "left_anti")
