"""The list of queries, each with its Spark form and, where SQL can say it, an independent SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECK_SQL: dict[str, str] = {}

PARTS: dict[str, tuple[str, list[str]]] = {}


def part(name: str, sql: str, needs: str = "") -> None:
    """A named subquery that check statements can build on."""
    PARTS[name] = (sql, needs.split())


def with_parts(needs: str, body: str, recursive: bool = False) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        if name in order or name not in PARTS:
            return
        for n in PARTS[name][1]:
            add(n)
        order.append(name)

    for n in needs.split():
        add(n)
    head = ",\n".join(f"{n} AS ({PARTS[n][0]})" for n in order)
    if not head:
        return body
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{body}"


def query(name: str, sql: str | None = None, needs: str = "", recursive: bool = False):
    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            CHECK_SQL[name] = with_parts(needs, sql, recursive)
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores when the scan has fewer parts than there are cores, as with few large row groups.

    Work on rows then runs in as many tasks; a scan of many parts is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
