"""Comparing rows that share a key, many keys in a task and a hot key in many tasks."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salience.llm.graph import stored

SLICE = 2048
AT_ONCE = 10_000


def meet_by_key(base: DataFrame, probes: DataFrame, meet: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``meet(base rows, probing rows)`` over groups in which each row of a key meets each probing row of it once.

    Both inputs are stored tables with a column key. Small keys share groups of about ``AT_ONCE`` rows; a key with more
    than ``SLICE`` rows on a side is cut into slices, and every slice of one side meets every slice of the other.
    """
    per_key = base.groupBy("key").agg(F.count("*").alias("n")).join(probes.groupBy("key").agg(F.count("*").alias("p")), "key")
    groups = max(1, base.count() // AT_ONCE)
    large = stored(per_key.filter((F.col("n") > SLICE) | (F.col("p") > SLICE)).select(
        "key", F.ceil(F.col("n") / SLICE).cast("int").alias("cuts"), F.ceil(F.col("p") / SLICE).cast("int").alias("probe_cuts")), "large")
    sliced = not large.isEmpty()
    group = F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("group")
    one = F.lit(1)
    cuts, probe_cuts = F.coalesce("cuts", one), F.coalesce("probe_cuts", one)

    def side(rows: DataFrame, own, other, own_name: str, other_name: str) -> DataFrame:
        if not sliced:
            return rows.select("*", group, F.lit(0).alias(own_name), F.lit(0).alias(other_name))
        dealt = rows.join(large, "key", "left")
        return dealt.select(*rows.columns, group, F.pmod(F.xxhash64("node"), own).cast("int").alias(own_name),
                            F.explode(F.sequence(F.lit(0), other - 1)).alias(other_name))

    keys = ["group", "slice", "probe_slice"]
    left = side(base, cuts, probe_cuts, "slice", "probe_slice")
    right = side(probes, probe_cuts, cuts, "probe_slice", "slice")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, schema)
