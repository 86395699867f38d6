"""Judging in steps: runs that continue where they stopped, and files judged as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from salience.operators.judge import pending


def results_so_far(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What earlier runs stored; an empty table when there was none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        # anything else, a changed schema or a denied folder, must not make finished work look open
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def continue_run(work: DataFrame, path: str, keys: list[str], schema: str, judge: Callable[[DataFrame], DataFrame]) -> None:
    """Judges what is still open and appends it. A finished run adds nothing; a broken one loses its open step only,
    since files become visible when the write commits."""
    todo = pending(work, results_so_far(work.sparkSession, path, schema), keys)
    judge(todo).write.mode("append").parquet(path)


def judge_arrivals(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str,
                   judge: Callable[[DataFrame], DataFrame], files_per_batch: int = 100):
    """Starts a query that judges each new file once and ends when all present files are done.

    Every micro-batch owns one folder and overwrites it, so a batch repeated after a failure does not count twice.
    """

    def store(batch: DataFrame, number: int) -> None:
        judge(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return (
        arrivals.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
