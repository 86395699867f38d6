"""Validation as data: each check counts its violations; raising is up to the caller."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DataError(ValueError):
    """A table breaks a rule it must keep."""


def row_checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``check, n`` for rules given as conditions a bad row fulfils; one aggregation for all of them."""
    counts = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()])
    return counts.unpivot([], list(rules), "check", "n")


def same_size(named: dict[str, DataFrame]) -> DataFrame:
    """Difference in row count of each table to the first one."""
    sizes = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in named.items()]
    first = next(iter(named))
    all_sizes = reduce(DataFrame.unionByName, sizes)
    base = all_sizes.agg(F.max(F.when(F.col("name") == first, F.col("n"))).alias("base"))
    return all_sizes.filter(F.col("name") != first).select(
        F.concat(F.lit("rows:"), "name").alias("check"), F.abs(F.col("n") - base.scalar()).alias("n"))


def bucket_digests(df: DataFrame, keys: list[str], columns: list[str], buckets: int) -> DataFrame:
    """``bucket, n, x, s`` of rows dealt by key: their number, and two sums over row hashes that no order changes."""
    row = F.xxhash64(*keys, *columns)
    return df.groupBy(_bucket(keys, buckets).alias("bucket")).agg(
        F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(row.cast("decimal(20,0)")).alias("s"))


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(7)), F.lit(buckets))


def table_difference(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], buckets: int = 4096) -> DataFrame:
    """``keys, side`` of the rows in which two stored tables differ: only in the ``first``, only in the ``second``, or ``changed``.

    Both tables are summed up in buckets of keys, a number that does not grow with them. Only rows of buckets whose sums
    differ are shuffled and compared, so tables that are nearly equal cost little more than two scans. A null in a key or
    column equals a null. Keys are unique in each table; a repeated key meets all rows that share it.
    """
    x, y = (bucket_digests(df, keys, columns, buckets) for df in (a, b))
    same = F.col("x.n").eqNullSafe(F.col("y.n")) & F.col("x.x").eqNullSafe(F.col("y.x")) & F.col("x.s").eqNullSafe(F.col("y.s"))
    differing = x.alias("x").join(y.alias("y"), F.col("x.bucket") == F.col("y.bucket"), "full_outer").filter(~same).select(
        F.coalesce("x.bucket", "y.bucket").alias("_bucket"))

    def open_rows(df: DataFrame, mark: str) -> DataFrame:
        values = F.struct(*columns) if columns else F.lit(0)
        rows = df.select(*keys, values.alias(mark), _bucket(keys, buckets).alias("_bucket"))
        return rows.join(F.broadcast(differing), "_bucket", "left_semi").drop("_bucket")

    both = [F.col(f"p.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys]
    met = open_rows(a, "_a").alias("p").join(open_rows(b, "_b").alias("q"), reduce(lambda u, v: u & v, both), "full_outer")
    side = F.when(F.col("_b").isNull(), "first").when(F.col("_a").isNull(), "second").when(F.col("_a") != F.col("_b"), "changed")
    return met.select(*[F.coalesce(f"p.{k}", f"q.{k}").alias(k) for k in keys], side.alias("side")).filter("side IS NOT NULL")


def keyed_equal(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], name: str) -> DataFrame:
    """Rows of one key set that the other lacks or that hold other values in ``columns``."""
    return table_difference(a, b, keys, columns).agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")


def need_columns(df: DataFrame, columns: list[str], what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DataError(f"{what} lacks {missing}; it has {df.columns}")


def raise_on(violations: DataFrame) -> None:
    """Fails when any check counted something. The table has one row per check."""
    bad = violations.filter("n > 0").collect()
    if bad:
        raise DataError("; ".join(f"{r['check']}: {r['n']}" for r in bad))


def chosen(values: list[str], allowed: list[str], aliases: dict[str, str] | None = None) -> list[str]:
    """Selected names in order without repeats, short forms resolved; an unknown one is an error."""
    out: list[str] = []
    for v in values:
        name = (aliases or {}).get(v, v)
        if name not in allowed:
            raise DataError(f"unknown {v!r}; one of {allowed}")
        if name not in out:
            out.append(name)
    return out
