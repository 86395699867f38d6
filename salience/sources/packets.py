"""Human evaluation files: the packet shown to annotators, its answer key, and the vote table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salience.operators.checks import DataError
from salience.sources.tables import read_records

# Fixed values of the packet and key layout.
NEXT_ITEM = "\nITEM "
ITEM_HEAD = r"(\d+)\n-{80}\n"
FIELDS = [
    ("document", "SOURCE DOCUMENT:", "REFERENCE SUMMARY:"),
    ("reference", "REFERENCE SUMMARY:", "CANDIDATE A:"),
    ("candidate_a", "CANDIDATE A:", "CANDIDATE B:"),
    ("candidate_b", "CANDIDATE B:", "(?:BEST ACCORDING TO|YOUR CHOICE)"),
]
KEY_ROW = r"^\s*(\d+)\s+(\d+)\s+(\w+)\s+(\d+)\s+(\w+)\s+(\w+)\s*$"
DIMENSIONS = ["faithfulness", "informativeness"]
VOTES = {"a": "A", "b": "B", "tie": "tie", "t": "tie"}
ONLY_ANNOTATOR = "annotator_1"


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    """``item, document, reference, candidate_a, candidate_b``; a field that cannot be found is an error.

    Files are cut where a line starts with ``ITEM``, so a file of any size is read in splits. A piece without a number and
    a rule is no item but text of the one before it, which may have started in an earlier split; text before the first
    item of a file is left out.
    """
    rows = read_records(spark, path, NEXT_ITEM)
    inside = W.partitionBy("file", "split").orderBy("at")
    first = (F.col("split") == 0) & (F.row_number().over(inside) == 1)
    number = F.when(first, F.regexp_extract("value", "^ITEM " + ITEM_HEAD, 1)).otherwise(F.regexp_extract("value", "^" + ITEM_HEAD, 1))
    rows = rows.withColumn("number", F.nullif(number, F.lit("")))
    rows = rows.withColumn("owner", F.last(F.when(F.col("number").isNotNull(), F.col("at")), ignorenulls=True).over(inside))
    earlier = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    # owners are not in order across splits, so the last one of a split is that of its last record
    ends = rows.groupBy("file", "split").agg(F.max_by("owner", "at").alias("end"))
    carried = ends.select("file", "split", F.last("end", ignorenulls=True).over(earlier).alias("carried"))
    owned = rows.join(carried, ["file", "split"]).withColumn("owner", F.coalesce("owner", "carried")).filter(F.col("owner").isNotNull())
    whole = owned.groupBy("owner").agg(F.max("number").cast("long").alias("item"), F.array_sort(F.collect_list(F.struct("split", "at", "value"))).alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda x: x["value"]), NEXT_ITEM)
    items = whole.select("item", F.regexp_replace(text, "^(?:ITEM )?" + ITEM_HEAD, "").alias("body"))

    def field(name: str, label: str, following: str):
        pattern = rf"(?sm)^{label}\n(.*?)\n\n{following}"
        missing = F.raise_error(F.concat(F.lit("item "), F.col("item").cast("string"), F.lit(f" has no {name}")))
        return F.when(F.regexp_like("body", F.lit(pattern)), F.regexp_extract("body", pattern, 1)).otherwise(missing).alias(name)

    return items.select("item", *[field(*f) for f in FIELDS])


def write_packets(items: DataFrame, path: str, per_file: int = 50) -> None:
    """Packets in the order of their items, the form annotators get; a file is a packet of at most ``per_file`` items."""
    body = F.concat(
        F.lit("ITEM "), F.col("item").cast("string"), F.lit("\n" + "-" * 80 + "\nSOURCE DOCUMENT:\n"), "document", F.lit("\n\nREFERENCE SUMMARY:\n"), "reference",
        F.lit("\n\nCANDIDATE A:\n"), "candidate_a", F.lit("\n\nCANDIDATE B:\n"), "candidate_b", F.lit("\n\nYOUR CHOICE: [ ]\n"))
    ordered = items.repartitionByRange("item").sortWithinPartitions("item")
    ordered.select(body.alias("value")).write.option("maxRecordsPerFile", per_file).text(path)


def read_answer_key(spark: SparkSession, path: str) -> DataFrame:
    """``item, grp, dataset, row, system_a, system_b`` from the fixed-width lines; all other lines are prose."""
    lines = spark.read.text(path).select("value").filter(F.regexp_like("value", F.lit(KEY_ROW)))
    part = lambda i: F.regexp_extract("value", KEY_ROW, i)
    return lines.select(part(1).cast("long").alias("item"), part(2).cast("long").alias("grp"), part(3).alias("dataset"),
                        part(4).cast("long").alias("row"), part(5).alias("system_a"), part(6).alias("system_b"))


def write_answer_key(key: DataFrame, path: str) -> None:
    key.select(F.format_string("%5d %6d  %-8s %8d  %-12s %s", "item", "grp", "dataset", "row", "system_a", "system_b").alias("value")).write.text(path)


def packet_with_key(items: DataFrame, key: DataFrame) -> DataFrame:
    """``item, in_packet, in_key, same_system``: how packet and key fit together."""
    a = items.select("item", F.lit(True).alias("_p"))
    b = key.select("item", F.lit(True).alias("_k"), (F.col("system_a") == F.col("system_b")).alias("same_system"))
    return a.join(b, "item", "full_outer").select(
        "item", F.col("_p").isNotNull().alias("in_packet"), F.col("_k").isNotNull().alias("in_key"), F.coalesce("same_system", F.lit(False)).alias("same_system"))


def joined_items(items: DataFrame, key: DataFrame) -> DataFrame:
    """Packet items with their key rows; any mismatch is an error."""
    fit = packet_with_key(items, key)
    bad = fit.agg(F.count_if(~(F.col("in_packet") & F.col("in_key"))).alias("lone"), F.count_if("same_system").alias("same")).first()
    if bad["lone"] or bad["same"]:
        raise DataError(f"{bad['lone']} items are in one file only, {bad['same']} have one system in both slots")
    return items.join(key, "item")


def read_vote_cells(spark: SparkSession, path: str) -> DataFrame:
    """``item, annotator, dimension, cell`` as text. Column names are matched in any case and order."""
    raw = spark.read.option("header", True).csv(path)
    named = raw.toDF(*[c.strip().lower() for c in raw.columns])
    if "item" not in named.columns:
        raise DataError(f"no item column; found {raw.columns}")
    present = [d for d in DIMENSIONS if d in named.columns]
    if not present:
        raise DataError(f"no dimension column; expected one of {DIMENSIONS}")
    who = F.coalesce(F.nullif(F.trim("annotator"), F.lit("")), F.lit(ONLY_ANNOTATOR)) if "annotator" in named.columns else F.lit(ONLY_ANNOTATOR)
    rows = named.select(F.trim("item").alias("item"), who.alias("annotator"), *[F.coalesce(d, F.lit("")).alias(d) for d in present])
    return rows.filter(F.coalesce("item", F.lit("")) != "").unpivot(["item", "annotator"], present, "dimension", "cell").withColumn(
        "cell", F.lower(F.trim("cell")))


def vote_value(cell):
    out = F.lit(None).cast("string")
    for text, vote in VOTES.items():
        out = F.when(cell == text, vote).otherwise(out)
    return out


def votes_from(cells: DataFrame) -> DataFrame:
    """``item, annotator, dimension, vote`` of the answered cells."""
    return cells.filter(F.col("cell") != "").select(
        F.col("item").try_cast("long").alias("item"), "annotator", "dimension", vote_value(F.col("cell")).alias("vote"))


def vote_violations(cells: DataFrame) -> DataFrame:
    """Cells that are no vote, and items that are no number a LONG can hold."""
    bad_item = ~F.regexp_like("item", F.lit(r"^\d+$")) | F.col("item").try_cast("long").isNull()
    bad_vote = (F.col("cell") != "") & vote_value(F.col("cell")).isNull()
    return cells.filter(bad_item | bad_vote).select("item", "annotator", "dimension", "cell", F.when(bad_item, "item").otherwise("vote").alias("problem"))
