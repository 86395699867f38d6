"""Building blocks that keep joins and ranks even when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from salience.functions.text import hex_number
from salience.session import scratch_path

BUCKET_DIGITS = 3
BUCKETS = 16 ** BUCKET_DIGITS
#: Shuffle partitions that are written into one file, and the files that a table may have at least.
FILE_PARTS = 8
FEWEST_FILES = 8


def settled(df: DataFrame) -> DataFrame:
    """The same rows with every column computed at this point, once.

    Catalyst writes the expression behind a column into the places that use it, which for array functions may mean
    once per element, and copies it into filters it pushes down. Columns that come out of a generator are left
    alone, so each row passes through an array of one struct. Narrow, no shuffle.
    """
    return df.select(F.explode_outer(F.array(F.struct(*df.columns))).alias("_row")).select("_row.*")


def dealt(df: DataFrame, rounds: int = 4) -> DataFrame:
    """The rows dealt over several tasks a core, for work that differs much from row to row; a scan of more parts is left as it is."""
    tasks = rounds * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def gathered(df: DataFrame) -> DataFrame:
    """Short rows made of long texts, dealt anew by their own bytes: a table of them has few files, not one for each task that read texts."""
    return df.hint("rebalance")


def in_few_files(shuffled: DataFrame) -> DataFrame:
    """Rows that come out of a shuffle, for writing: a task writes several partitions of it, one after the other, into one file.

    Their number follows that of shuffle partitions, with eight at least.
    """
    parts = int(shuffled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shuffled.coalesce(max(FEWEST_FILES, parts // FILE_PARTS))


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the session's scratch folder, for what several steps read: computed once, safe against lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def heavy_keys(per_key: DataFrame, weight: str, most: int) -> Column:
    """True for keys that hold more than ``1/most`` of the summed weight.

    The weights of all keys add up to the total, so at most ``most`` keys can pass. That is what makes a
    broadcast of the passing rows safe at any data size.
    """
    total = per_key.select(F.sum(weight)).scalar()
    return F.col(weight) * F.lit(most) > total


def even_join(rows: DataFrame, per_key: DataFrame, keys: list[str], weight: str, most: int = 1000) -> DataFrame:
    """Inner join of ``rows`` to a table with one row per key, safe against hot keys.

    ``weight`` counts the rows of each key. Rows of heavy keys meet a broadcast of at most ``most`` table
    rows and are never shuffled; each remaining key holds at most ``1/most`` of the rows, so the shuffled
    part has no hot key. The input is read by both branches, which costs less than shuffling all of it.
    """
    heavy = heavy_keys(per_key, weight, most)
    values = [c for c in per_key.columns if c != weight]
    head = F.broadcast(per_key.filter(heavy).select(*values))
    tail = per_key.filter(~heavy).select(*values)
    light_rows = rows.join(F.broadcast(per_key.filter(heavy).select(*keys)), keys, "left_anti")
    return rows.join(head, keys).unionByName(light_rows.join(tail, keys))


def rank_by_digest(df: DataFrame, groups: list[str], digest: str, index: str = "idx",
                   tie: list[str] | None = None) -> DataFrame:
    """Exact zero-based rank inside each group in digest order.

    Digests are uniform, so their first digits cut every group, however large, into even buckets. Ranks
    inside a bucket come from a window over the bucket; bucket offsets come from at most 4096 counts a group.
    """
    spread = df.withColumn("_bucket", hex_number(F.col(digest), 1, BUCKET_DIGITS))
    part = groups + ["_bucket"]
    offsets = (
        spread.groupBy(*part).agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(
            F.sum("_n").over(W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0)))
        .select(*part, "_before")
    )
    inside = W.partitionBy(*part).orderBy(digest, *(tie or []))
    return (
        spread.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(offsets, part)
        .withColumn(index, (F.col("_before") + F.col("_rank")).cast("long"))
        .drop("_bucket", "_before", "_rank")
    )


def smallest_digests(df: DataFrame, groups: list[str], digest: str, n: int,
                     tie: list[str] | None = None) -> DataFrame:
    """The ``n`` rows of each group with the smallest digests.

    Counts per digest bucket tell which buckets can hold them, so all other rows are dropped before any row
    is shuffled or ranked.
    """
    spread = df.withColumn("_bucket", hex_number(F.col(digest), 1, BUCKET_DIGITS))
    counts = spread.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*groups).orderBy("_bucket"))
    reach = (
        counts.withColumn("_before", upto - F.col("_n"))
        .filter(F.col("_before") < n)
        .groupBy(*groups).agg(F.max("_bucket").alias("_last"))
    )
    sizes = counts.groupBy(*groups).agg(F.sum("_n").alias("_size"))
    near = even_join(spread, reach.join(sizes, groups), groups, "_size").filter(F.col("_bucket") <= F.col("_last")).drop("_bucket", "_last")
    return rank_by_digest(near, groups, digest, "_pick", tie).filter(F.col("_pick") < n).drop("_pick")


def rank_by_number(df: DataFrame, order: str, index: str = "idx", buckets: int = 1024) -> DataFrame:
    """Exact zero-based position of each row in the order of a unique number column.

    Approximate quantiles, a list of fixed length, cut the column into even ranges. They only decide the
    evenness of the ranges; the positions are exact whatever the cuts are.
    """
    cuts = sorted(set(df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 1.0 / (4 * buckets))))
    ranged = df.withColumn("_range", _range_number(F.col(order), cuts))
    offsets = (
        ranged.groupBy("_range").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(
            F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .select("_range", "_before")
    )
    return (
        ranged.withColumn("_rank", F.row_number().over(W.partitionBy("_range").orderBy(order)) - 1)
        .join(offsets, "_range")
        .withColumn(index, (F.col("_before") + F.col("_rank")).cast("long"))
        .drop("_range", "_before", "_rank")
    )


def _range_number(x: Column, cuts: list[float], step: int = 32) -> Column:
    """How many cuts lie at or below ``x``: first among every 32nd cut, then inside that stretch."""
    if not cuts:
        return F.lit(0)
    stretches = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    numbers = lambda v: F.array(*[F.lit(float(c)) for c in v])
    below = lambda arr: F.size(F.filter(arr, lambda c: c <= x))
    at = below(numbers([s[0] for s in stretches]))
    inside = below(F.element_at(F.array(*[numbers(s) for s in stretches]), F.greatest(at, F.lit(1))))
    return F.when(at > 0, (at - 1) * step + inside).otherwise(F.lit(0))
