"""Corpus and dataset tables, their splits, and record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salience.functions.text import strip
from salience.operators.checks import DataError

# Source columns of the known fine-tuning sets.
COLUMN_NAMES = {
    "headline": "summary", "text": "document",
    "highlights": "summary", "article": "document",
}


def read_corpus(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """A corpus with a declared schema; nothing is inferred from the data."""
    return spark.read.schema(schema).format(form).load(path)


def canonical(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    return df.withColumnsRenamed(names or COLUMN_NAMES)


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per split, so that reading a split reads nothing else."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Rows of one split; a missing one is an error that names the splits there are."""
    df = spark.read.parquet(path)
    rows = df.filter(F.col("split") == split)
    if rows.isEmpty():
        names = sorted(r[0] for r in df.select("split").distinct().collect())
        raise DataError(f"split {split!r} is not in {path}; it has {names}")
    return rows


def drop_split(df: DataFrame, split: str) -> DataFrame:
    return df.filter(F.col("split") != split)


def merge_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Partial outputs as one set, in one scan."""
    return spark.read.parquet(*paths)


def read_record_array(spark: SparkSession, path: str, schema: str, one_per_line: bool = False) -> DataFrame:
    """JSON arrays of records: one array per file, or one per line. A file that is one array cannot be split."""
    return spark.read.schema(schema).option("multiLine", not one_per_line).json(path)


def write_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_record_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a line cut short by an interrupted writer is left out."""
    bad = "_corrupt_record"
    rows = spark.read.schema(f"{schema}, {bad} STRING").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", bad).json(path)
    return rows.filter(F.col(bad).isNull()).drop(bad)


def write_table_text(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header, quotes doubled, line breaks inside cells kept."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_table_text(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_lines(df: DataFrame, path: str, key: str, column: str, mode: str = "errorifexists") -> None:
    """One flattened text per line in the order of ``key``, range-partitioned so that file order is line order."""
    text = F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), r"[\r\n]+", " ")).alias("value")
    df.repartitionByRange(key).sortWithinPartitions(key).select(text).write.mode(mode).text(path)


def read_records(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """``file, split, at, value``: the records of text files, lines unless a separator is given.

    Files are read in splits. ``at`` is unique, and rises by one from record to record of a split.
    """
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, value`` with zero-based line numbers over the files in name order.

    A line's number is its place in its split after the lines of all splits before, which are prefix sums over a table of
    one row per split. The text itself is not ordered or regrouped for it.
    """
    rows = read_records(spark, path)
    splits = rows.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file", "split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = splits.select("file", "split", (before - F.col("first")).alias("shift"))
    return rows.join(shifts, ["file", "split"]).select((F.col("at") + F.col("shift")).alias("line"), strip(F.col("value")).alias("value"))


def align_lines(rows: DataFrame, lines: DataFrame, index: str, column: str) -> DataFrame:
    """Rows with the line of the same number, in one pass; a row without a line or a line without a row is an error."""
    a = rows.withColumn("_row", F.lit(True))
    b = lines.select(F.col("line").alias(index), F.col("value").alias("_line"), F.lit(True).alias("_has"))
    lone = F.when(F.col("_row").isNull(), F.lit("no row for line ")).when(F.col("_has").isNull(), F.lit("no line for row "))
    value = F.when(lone.isNotNull(), F.raise_error(F.concat(lone, F.col(index).cast("string")))).otherwise(F.col("_line"))
    return a.join(b, index, "full_outer").select(index, *[c for c in rows.columns if c != index], value.alias(column))
