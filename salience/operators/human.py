"""Human votes: majorities, agreement among annotators, and agreement with a judge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salience.functions.moments import kappa, tau_b
from salience.functions.text import r6
from salience.functions.verdict import winner_by_key

# Vote levels, and verdicts from b over tie to a.
VOTE_LEVELS = ["A", "B", "tie"]
WINNER_LEVELS = ["b", "tie", "a"]

#: Votes of an item that stand in one row.
BLOCK = 64


def majority(votes: DataFrame) -> DataFrame:
    """The vote more than half of an item's annotators gave, else NULL. Only counts are kept, never lists of votes."""
    c = votes.groupBy("item", "dimension").agg(F.count("*").alias("n"), *[F.count_if(F.col("vote") == v).alias(v) for v in VOTE_LEVELS])
    out = F.lit(None).cast("string")
    for v in VOTE_LEVELS:
        out = F.when(F.col(v) * 2 > F.col("n"), v).otherwise(out)
    return c.select("item", "dimension", "n", out.alias("vote"))


def with_judge(major: DataFrame, key: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Majority and judge per item and dimension, as slots and as systems; items without either stay, marked NULL.

    ``verdicts`` holds ``item, dimension, raw_result``.
    """
    rows = major.join(key.select("item", "dataset", "system_a", "system_b"), "item").join(verdicts, ["item", "dimension"], "left")
    named = lambda slot: winner_by_key(F.col(slot), F.col("system_a"), F.col("system_b"))
    return rows.select(
        "item", "dimension", "dataset", F.col("vote").alias("human_slot"), F.col("raw_result").alias("judge_slot"),
        F.when(F.col("vote").isNotNull(), named("vote")).alias("human"), F.when(F.col("raw_result").isNotNull(), named("raw_result")).alias("judge"))


def excluded(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dimension").agg(
        F.count_if(F.col("human").isNull()).alias("no_majority"), F.count_if(F.col("human").isNotNull() & F.col("judge").isNull()).alias("no_verdict"),
        F.count_if(F.col("human").isNotNull() & F.col("judge").isNotNull()).alias("compared"))


def agreement(rows: DataFrame) -> DataFrame:
    """Agreement, kappa and tau-b of majority and judge per dataset and over all, by one grouping-sets pass."""
    rank = lambda c: F.when(F.col(c) == "a", 1).when(F.col(c) == "tie", 0).otherwise(-1)
    known = rows.filter(F.col("human").isNotNull() & F.col("judge").isNotNull())
    sets = known.groupingSets([["dimension", "dataset"], ["dimension"]], "dimension", "dataset").agg(
        F.grouping("dataset").alias("_all"), F.count("*").alias("n"),
        r6(F.avg((F.col("human") == F.col("judge")).cast("double"))).alias("agree"),
        r6(kappa(F.col("human"), F.col("judge"), WINNER_LEVELS)).alias("kappa"), r6(tau_b(rank("human"), rank("judge"), [-1, 0, 1])).alias("tau_b"),
        *[F.count_if(F.col(who) == w).alias(f"{who}_{w}") for who in ("human", "judge") for w in ("a", "tie")])
    return sets.withColumn("dataset", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("dataset"))).drop("_all")


def slot_rates(rows: DataFrame) -> DataFrame:
    """How often slot A wins, for humans and the judge, over items both decided."""
    both = rows.filter(F.col("human_slot").isin("A", "B") & F.col("judge_slot").isin("A", "B"))
    rate = lambda c: r6(F.avg((F.col(c) == "A").cast("double")))
    return both.groupBy("dimension").agg(F.count("*").alias("n"), rate("human_slot").alias("human_a"), rate("judge_slot").alias("judge_a"))


def annotator_pairs(votes: DataFrame, block: int = BLOCK) -> DataFrame:
    """``dimension, first, second, x, y, n``: how often two annotators gave which votes to the same item.

    An item's votes, in the order of the annotators, are cut into blocks, and each two blocks of an item meet in a row of
    their own, so a row stays small however many annotators an item has. Equal pairs of blocks are counted before their
    votes are paired; small panels are one block, so the work grows with the number of different ballots rather than with
    the items.
    """
    place = F.row_number().over(W.partitionBy("item", "dimension").orderBy("annotator", "vote"))
    placed = votes.select("item", "dimension", "annotator", "vote", F.floor((place - 1) / block).alias("block"))
    blocks = placed.groupBy("item", "dimension", "block").agg(F.array_sort(F.collect_list(F.struct("annotator", "vote"))).alias("ballot"))
    p, q = blocks.alias("p"), blocks.alias("q")
    same = lambda c: F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}"))
    met = p.join(q, same("item") & same("dimension") & (F.col("p.block") <= F.col("q.block"))).select(
        "p.dimension", F.col("p.ballot").alias("p"), F.col("q.ballot").alias("q"), (F.col("p.block") == F.col("q.block")).alias("own"))
    kinds = met.filter(~F.col("own") | (F.size("p") > 1)).groupBy("dimension", "p", "q", "own").agg(F.count("*").alias("n"))
    pairs = F.flatten(F.transform("p", lambda a, i: F.transform(
        F.slice("q", F.when(F.col("own"), i + 2).otherwise(1), F.size("q")), lambda b: F.struct(
            a["annotator"].alias("first"), b["annotator"].alias("second"), a["vote"].alias("x"), b["vote"].alias("y")))))
    return kinds.select("dimension", "n", F.explode(pairs).alias("v")).groupBy(
        "dimension", "v.first", "v.second", "v.x", "v.y").agg(F.sum("n").alias("n"))


def panel_agreement(votes: DataFrame) -> DataFrame:
    """Mean agreement over all rated pairs and mean kappa over annotator pairs that share more than one item."""
    pairs = annotator_pairs(votes)
    n = F.col("n").cast("double")

    def weighted(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0.0))

    same = weighted(F.col("x") == F.col("y"))
    total = F.sum(n)
    chance = sum((weighted(F.col("x") == v) * weighted(F.col("y") == v) for v in VOTE_LEVELS[1:]),
                 weighted(F.col("x") == VOTE_LEVELS[0]) * weighted(F.col("y") == VOTE_LEVELS[0]))
    each = pairs.groupBy("dimension", "first", "second").agg(
        total.alias("n"), same.alias("same"), F.try_divide(same * total - chance, F.nullif(total * total - chance, F.lit(0.0))).alias("kappa"))
    per = each.groupBy("dimension").agg(
        (F.sum("same") / F.sum("n")).alias("agreement"), F.avg(F.when(F.col("n") > 1, F.col("kappa"))).alias("kappa"))
    raters = votes.select(F.countDistinct("annotator")).scalar()
    return per.select("dimension", r6(F.col("agreement")).alias("agreement"), r6(F.col("kappa")).alias("kappa"), raters.alias("raters"))


def slot_balance(key: DataFrame) -> DataFrame:
    """How often system a stands in slot A, per dataset and overall."""
    sums = key.rollup("dataset").agg(F.grouping("dataset").alias("_all"), F.count("*").alias("n"), F.count_if(F.lower("system_a") == "a").alias("a_in_slot_a"))
    return sums.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("dataset")).alias("dataset"), "n", "a_in_slot_a")


def dimension_summary(rows: DataFrame) -> DataFrame:
    """Judge verdicts per dimension and dataset, with a line per dimension over all datasets."""
    sums = rows.filter(F.col("judge").isNotNull()).groupingSets([["dimension", "dataset"], ["dimension"]], "dimension", "dataset").agg(
        F.grouping("dataset").alias("_all"), F.count("*").alias("n"), *[F.count_if(F.col("judge") == w).alias(w) for w in ("a", "b", "tie")],
        F.count_if(F.col("judge_slot") == "TIE_2").alias("no_tag"))
    return sums.select("dimension", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("dataset")).alias("dataset"), "n", "a", "b", "tie", "no_tag")


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, with the side."""
    x, y = a.select(key), b.select(key)
    return x.exceptAll(y).withColumn("side", F.lit("first")).unionByName(y.exceptAll(x).withColumn("side", F.lit("second")))
