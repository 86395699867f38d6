"""Queries on human votes and their agreement with the judge."""

from __future__ import annotations

from pyspark.sql import functions as F

from salience.functions import text as tx
from salience.functions import verdict as vd
from salience.operators import human, judge
from salience.plans.derive import predictions
from salience.plans.judging import raw_sql, said_sql
from salience.plans.registry import part, query, table
from salience.session import scratch_path
from salience.sources import packets

ANNOTATORS = ["ann1", "ann2", "ann3"]

part("cells", """SELECT doc_id AS item, annotator, dimension, CASE WHEN u = 15 THEN '' WHEN quality = 1 AND u < 9 THEN 'A' WHEN quality = 0 AND u < 5 THEN 'A' WHEN u < 11 THEN ' b' ELSE 'Tie' END AS cell FROM (
  SELECT *, ('0x' || substr(md5(doc_id || ':' || annotator || ':' || dimension), 1, 1))::BIGINT AS u FROM labels, (VALUES ('ann1'), ('ann2'), ('ann3')) a(annotator), (VALUES ('faithfulness'), ('informativeness')) d(dimension))""")
part("votes", "SELECT item, annotator, dimension, CASE lower(trim(cell)) WHEN 'a' THEN 'A' WHEN 'b' THEN 'B' ELSE 'tie' END AS vote FROM cells WHERE trim(cell) <> ''", "cells")
part("akey", """SELECT doc_id AS item, doc_id // 50 AS grp, lang AS dataset, doc_id AS row, CASE WHEN s THEN 'a' ELSE 'b' END AS system_a, CASE WHEN s THEN 'b' ELSE 'a' END AS system_b FROM (
  SELECT l.doc_id, d.lang, ('0x' || substr(md5('key:' || l.doc_id), 1, 1))::BIGINT < 8 AS s FROM labels l JOIN documents d USING (doc_id))""")
part("major", """SELECT item, dimension, n, CASE WHEN 2 * a > n THEN 'A' WHEN 2 * b > n THEN 'B' WHEN 2 * t > n THEN 'tie' END AS vote FROM (
  SELECT item, dimension, count(*) AS n, count(*) FILTER (WHERE vote = 'A') AS a, count(*) FILTER (WHERE vote = 'B') AS b, count(*) FILTER (WHERE vote = 'tie') AS t FROM votes GROUP BY ALL)""", "votes")
part("hv", f"""SELECT item, dimension, {raw_sql('c')} AS raw_result FROM (
  SELECT k.item, 'faithfulness' AS dimension, {said_sql('sa', 'sb', 1, 0)} AS c FROM (SELECT *, CASE WHEN system_a = 'a' THEN summary_a ELSE summary_b END AS sa, CASE WHEN system_a = 'a' THEN summary_b ELSE summary_a END AS sb FROM akey JOIN pred ON item = doc_id) k
  UNION ALL SELECT k.item, 'informativeness', {said_sql('sa', 'sb', 0, 2)} FROM (SELECT *, CASE WHEN system_a = 'a' THEN summary_a ELSE summary_b END AS sa, CASE WHEN system_a = 'a' THEN summary_b ELSE summary_a END AS sb FROM akey JOIN pred ON item = doc_id) k)""", "akey pred")
# Items that were voted on but have no verdict: one for each page. Items that only the answer key has: one for each test.
part("pagekey", """SELECT 1000000000 + page_id AS item, 0::BIGINT AS grp, 'pages' AS dataset, page_id AS row, 'a' AS system_a, 'b' AS system_b FROM pages""")
part("testkey", """SELECT 2000000000 + item_id AS item, 0::BIGINT AS grp, 'tests' AS dataset, item_id AS row, 'a' AS system_a, 'a' AS system_b FROM benchmark""")
part("allkey", "SELECT * FROM akey UNION ALL SELECT * FROM pagekey", "akey pagekey")
part("allmajor", """SELECT * FROM major UNION ALL SELECT item, dimension, 3, 'A' FROM pagekey, (VALUES ('faithfulness'), ('informativeness')) d(dimension)""", "major pagekey")
part("hj", """SELECT m.item, m.dimension, k.dataset, m.vote AS human_slot, v.raw_result AS judge_slot, CASE m.vote WHEN 'A' THEN system_a WHEN 'B' THEN system_b WHEN 'tie' THEN 'tie' END AS human,
  CASE v.raw_result WHEN 'A' THEN system_a WHEN 'B' THEN system_b ELSE CASE WHEN v.raw_result IS NOT NULL THEN 'tie' END END AS judge
  FROM allmajor m JOIN allkey k USING (item) LEFT JOIN hv v ON v.item = m.item AND v.dimension = m.dimension""", "allmajor allkey hv")


def cells(spark, sf):
    base = table(spark, sf, "labels").select(
        F.col("doc_id").alias("item"), "quality", F.explode(F.array(*[F.lit(a) for a in ANNOTATORS])).alias("annotator"))
    rows = base.select("*", F.explode(F.array(*[F.lit(d) for d in packets.DIMENSIONS])).alias("dimension"))
    u = tx.hex_number(tx.keyed_digest(F.col("item"), F.col("annotator"), F.col("dimension")), 1, 1)
    limit = F.when(F.col("quality") == 1, 9).otherwise(5)
    return rows.select("item", "annotator", "dimension", F.when(u == 15, "").when(u < limit, "A").when(u < 11, " b").otherwise("Tie").alias("cell"))


def votes(spark, sf):
    c = cells(spark, sf)
    return packets.votes_from(c.select(F.col("item").cast("string").alias("item"), "annotator", "dimension", F.lower(F.trim("cell")).alias("cell")))


def answer_key(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    s = tx.hex_number(tx.keyed_digest("key", F.col("doc_id")), 1, 1) < 8
    return rows.select(F.col("doc_id").alias("item"), F.floor(F.col("doc_id") / 50).cast("long").alias("grp"), F.col("lang").alias("dataset"), F.col("doc_id").alias("row"),
                       F.when(s, "a").otherwise("b").alias("system_a"), F.when(s, "b").otherwise("a").alias("system_b"))


def slotted(spark, sf):
    rows = predictions(spark, sf, with_text=True).join(answer_key(spark, sf).withColumnRenamed("dataset", "_ds"), F.col("doc_id") == F.col("item"))
    sa, sb = vd.slot_texts(F.col("summary_a"), F.col("summary_b"), F.col("system_a") == "a")
    return rows.withColumn("sa", sa).withColumn("sb", sb)


def verdicts(spark, sf):
    rows = slotted(spark, sf)
    said = lambda bonus, margin: vd.raw_result(judge.rule_completion(F.col("reference"), F.col("sa"), F.col("sb"), bonus, margin))
    both = F.array(
        F.struct(F.lit("faithfulness").alias("dimension"), said(1, 0).alias("raw_result")),
        F.struct(F.lit("informativeness").alias("dimension"), said(0, 2).alias("raw_result")))
    return rows.select("item", F.explode(both).alias("x")).select("item", "x.*")


def foreign_key(spark, sf, name, key, first, system_b):
    """Key rows for items that belong to another table."""
    return table(spark, sf, name).select((F.lit(first) + F.col(key)).alias("item"), F.lit(0).cast("long").alias("grp"), F.lit(name if name == "pages" else "tests").alias("dataset"),
                                         F.col(key).alias("row"), F.lit("a").alias("system_a"), F.lit(system_b).alias("system_b"))


def page_key(spark, sf):
    return foreign_key(spark, sf, "pages", "page_id", 1_000_000_000, "b")


def compared(spark, sf):
    """Majorities and verdicts; the items of pages were voted on but never judged."""
    more = page_key(spark, sf).select("item", F.explode(F.array(*[F.lit(a) for a in ANNOTATORS])).alias("annotator"))
    more = more.select("item", "annotator", F.explode(F.array(*[F.lit(d) for d in packets.DIMENSIONS])).alias("dimension"), F.lit("A").alias("vote"))
    major = human.majority(votes(spark, sf).unionByName(more))
    return human.with_judge(major, answer_key(spark, sf).unionByName(page_key(spark, sf)), verdicts(spark, sf))


@query("vote_table_round_trip", "SELECT item, annotator, dimension, vote FROM votes", "votes")
def vote_table(spark, sf):
    path = scratch_path(spark, "votes")
    wide = cells(spark, sf).groupBy("item", "annotator").pivot("dimension", packets.DIMENSIONS).agg(F.first("cell"))
    wide.select(F.col("annotator").alias("Annotator"), F.col("informativeness").alias("Informativeness"), F.col("item").alias("ITEM"), "faithfulness").write.option("header", True).csv(path)
    return packets.votes_from(packets.read_vote_cells(spark, path))


@query("vote_violations", "SELECT item::VARCHAR AS item, annotator, dimension, 'maybe' AS cell, 'vote' AS problem FROM cells WHERE item % 50 = 0", "cells")
def vote_violations(spark, sf):
    c = cells(spark, sf).select(F.col("item").cast("string").alias("item"), "annotator", "dimension",
                                F.when(F.col("item") % 50 == 0, "maybe").otherwise(F.lower(F.trim("cell"))).alias("cell"))
    return packets.vote_violations(c)


def _packet_items(spark, sf):
    s = slotted(spark, sf)
    flat = lambda c: tx.flatten_lines(F.col(c))
    return s.select("item", flat("text").alias("document"), flat("reference").alias("reference"), flat("sa").alias("candidate_a"), flat("sb").alias("candidate_b"))


@query("packet_round_trip", r"""SELECT item, dataset, system_a, system_b, md5(trim(regexp_replace(text, '[\r\n]+', ' ', 'g'))) AS document, reference, sa AS candidate_a, sb AS candidate_b FROM (
  SELECT k.*, p.text, p.reference, CASE WHEN system_a = 'a' THEN summary_a ELSE summary_b END AS sa, CASE WHEN system_a = 'a' THEN summary_b ELSE summary_a END AS sb FROM akey k JOIN pred p ON item = doc_id)""", "akey pred")
def packet_round_trip(spark, sf):
    a, b = scratch_path(spark, "packets"), scratch_path(spark, "key")
    packets.write_packets(_packet_items(spark, sf), a)
    packets.write_answer_key(answer_key(spark, sf), b)
    rows = packets.joined_items(packets.read_packets(spark, a), packets.read_answer_key(spark, b))
    return rows.select("item", "dataset", "system_a", "system_b", F.md5("document").alias("document"), "reference", "candidate_a", "candidate_b")


def _packet_and_key(spark, sf):
    """All items; those of pages are in the packet only, those of tests in the key only."""
    k = answer_key(spark, sf)
    return k.unionByName(page_key(spark, sf)), k.unionByName(foreign_key(spark, sf, "benchmark", "item_id", 2_000_000_000, "a"))


@query("packet_key_check", """SELECT item, true AS in_packet, true AS in_key, false AS same_system FROM akey UNION ALL SELECT item, true, false, false FROM pagekey
  UNION ALL SELECT item, false, true, true FROM testkey""", "akey pagekey testkey")
def packet_key_check(spark, sf):
    return packets.packet_with_key(*_packet_and_key(spark, sf))


@query("key_difference", "SELECT item, 'first' AS side FROM pagekey UNION ALL SELECT item, 'second' FROM testkey", "pagekey testkey")
def key_difference(spark, sf):
    return human.key_difference(*_packet_and_key(spark, sf), "item")


@query("majority_votes", "SELECT * FROM major", "major")
def majority_votes(spark, sf):
    return human.majority(votes(spark, sf))


@query("human_and_judge", "SELECT * FROM hj", "hj")
def human_and_judge(spark, sf):
    return compared(spark, sf)


@query("excluded_items", """SELECT dimension, count(*) FILTER (WHERE human IS NULL) AS no_majority, count(*) FILTER (WHERE human IS NOT NULL AND judge IS NULL) AS no_verdict,
  count(*) FILTER (WHERE human IS NOT NULL AND judge IS NOT NULL) AS compared FROM hj GROUP BY dimension""", "hj")
def excluded_items(spark, sf):
    return human.excluded(compared(spark, sf))


part("hk", """SELECT item, dimension, g AS dataset, human, judge, CASE human WHEN 'a' THEN 1 WHEN 'tie' THEN 0 ELSE -1 END AS x, CASE judge WHEN 'a' THEN 1 WHEN 'tie' THEN 0 ELSE -1 END AS y
  FROM (SELECT *, dataset AS g FROM hj UNION ALL SELECT *, 'ALL' FROM hj) WHERE human IS NOT NULL AND judge IS NOT NULL""", "hj")
part("hpe", """SELECT dimension, dataset, sum(h.c::DOUBLE * j.c) AS chance FROM (SELECT dimension, dataset, human AS v, count(*) AS c FROM hk GROUP BY ALL) h
  JOIN (SELECT dimension, dataset, judge AS v, count(*) AS c FROM hk GROUP BY ALL) j USING (dimension, dataset, v) GROUP BY ALL""", "hk")
part("htau", """SELECT a.dimension, a.dataset, sum(sign((a.x - b.x) * (a.y - b.y))) AS s, count(*) - count(*) FILTER (WHERE a.x = b.x) AS nx, count(*) - count(*) FILTER (WHERE a.y = b.y) AS ny
  FROM hk a JOIN hk b ON a.dimension = b.dimension AND a.dataset = b.dataset AND a.item < b.item GROUP BY ALL""", "hk")


@query("human_judge_agreement", """SELECT k.dimension, k.dataset, count(*) AS n, round(avg((human = judge)::INT::DOUBLE), 6) AS agree,
  round((count(*) FILTER (WHERE human = judge) * count(*) - any_value(coalesce(e.chance, 0))) / nullif(count(*)::DOUBLE * count(*) - any_value(coalesce(e.chance, 0)), 0), 6) AS kappa,
  round(any_value(t.s) / nullif(sqrt(any_value(t.nx)::DOUBLE * any_value(t.ny)), 0), 6) AS tau_b,
  count(*) FILTER (WHERE human = 'a') AS human_a, count(*) FILTER (WHERE human = 'tie') AS human_tie, count(*) FILTER (WHERE judge = 'a') AS judge_a, count(*) FILTER (WHERE judge = 'tie') AS judge_tie
  FROM hk k LEFT JOIN hpe e USING (dimension, dataset) LEFT JOIN htau t USING (dimension, dataset) GROUP BY k.dimension, k.dataset""", "hk hpe htau")
def human_judge_agreement(spark, sf):
    return human.agreement(compared(spark, sf))


@query("slot_rates", """SELECT dimension, count(*) AS n, round(avg((human_slot = 'A')::INT), 6) AS human_a, round(avg((judge_slot = 'A')::INT), 6) AS judge_a FROM hj
  WHERE human_slot IN ('A', 'B') AND judge_slot IN ('A', 'B') GROUP BY dimension""", "hj")
def slot_rates(spark, sf):
    return human.slot_rates(compared(spark, sf))


part("vp", "SELECT a.dimension, a.annotator AS p, b.annotator AS q, a.vote AS x, b.vote AS y FROM votes a JOIN votes b ON a.item = b.item AND a.dimension = b.dimension AND a.annotator < b.annotator", "votes")


@query("panel_agreement", """SELECT dimension, round(sum(same)::DOUBLE / sum(n), 6) AS agreement, round(avg((same * n - chance) / nullif(n::DOUBLE * n - chance, 0)) FILTER (WHERE n > 1), 6) AS kappa, (SELECT count(DISTINCT annotator) FROM votes) AS raters FROM (
  SELECT dimension, p, q, count(*) AS n, count(*) FILTER (WHERE x = y) AS same,
  (count(*) FILTER (WHERE x = 'A') * count(*) FILTER (WHERE y = 'A') + count(*) FILTER (WHERE x = 'B') * count(*) FILTER (WHERE y = 'B') + count(*) FILTER (WHERE x = 'tie') * count(*) FILTER (WHERE y = 'tie'))::DOUBLE AS chance FROM vp GROUP BY ALL) GROUP BY dimension""", "vp votes")
def panel_agreement(spark, sf):
    return human.panel_agreement(votes(spark, sf))


@query("slot_balance", "SELECT CASE WHEN grouping(dataset) = 1 THEN 'ALL' ELSE dataset END AS dataset, count(*) AS n, count(*) FILTER (WHERE system_a = 'a') AS a_in_slot_a FROM akey GROUP BY ROLLUP (dataset)", "akey")
def slot_balance(spark, sf):
    return human.slot_balance(answer_key(spark, sf))


@query("dimension_summary", """SELECT dimension, CASE WHEN grouping(dataset) = 1 THEN 'ALL' ELSE dataset END AS dataset, count(*) AS n, count(*) FILTER (WHERE judge = 'a') AS a, count(*) FILTER (WHERE judge = 'b') AS b,
  count(*) FILTER (WHERE judge = 'tie') AS tie, count(*) FILTER (WHERE judge_slot = 'TIE_2') AS no_tag FROM hj WHERE judge IS NOT NULL GROUP BY GROUPING SETS ((dimension, dataset), (dimension))""", "hj")
def dimension_summary(spark, sf):
    return human.dimension_summary(compared(spark, sf))


PROMPT = " || ".join(f"'{x}'" if i % 2 == 0 else x for i, x in enumerate(
    y for piece, value in zip(vd.TASK_WITH_SOURCE.split("%s"), ["criterion", "document", "reference", "sa", "sb", ""]) for y in (piece, value) if y))


@query("source_prompts", f"""SELECT item, dimension, md5({PROMPT}) AS prompt FROM (SELECT k.item, p.text AS document, p.reference,
    CASE WHEN system_a = 'a' THEN summary_a ELSE summary_b END AS sa, CASE WHEN system_a = 'a' THEN summary_b ELSE summary_a END AS sb FROM akey k JOIN pred p ON item = doc_id),
  (VALUES {", ".join(f"('{k}', '{v}')" for k, v in vd.CRITERIA.items())}) c(dimension, criterion)""", "akey pred")
def source_prompts(spark, sf):
    """The whole prompt of every dimension, as a digest."""
    s = slotted(spark, sf).select("item", "text", "reference", "sa", "sb", F.explode(F.array(*[F.lit(k) for k in vd.CRITERIA])).alias("dimension"))
    prompt = vd.source_prompt(F.col("dimension"), F.col("text"), F.col("reference"), F.col("sa"), F.col("sb"))
    return s.select("item", "dimension", F.md5(prompt.cast("binary")).alias("prompt"))
