"""Tables the queries share, derived from the given ones, and the same tables as SQL parts.

System ``a`` picks sentences by word overlap, system ``b`` by count PMI, ``c`` by word-pair overlap; the first
sentence is the reference, the language is the dataset and the source is the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salience.functions import text as tx
from salience.operators import scoring, select
from salience.plans.registry import part, spread, table

SENTS = r"""list_filter(list_transform(regexp_extract_all({x}, '[^.!?]+[.!?]*'),
  lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> '')"""

TOKS = "regexp_extract_all(lower({x}), '[a-z0-9]+')"
WORDS = r"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def sents_sql(x: str) -> str:
    return SENTS.replace("{x}", x)


def toks_sql(x: str) -> str:
    return TOKS.replace("{x}", x)


def words_sql(x: str) -> str:
    return WORDS.replace("{x}", x)


def masked_sql(sents: str, sid: str) -> str:
    return f"array_to_string(list_transform({sents}, lambda s, i: CASE WHEN i - 1 = {sid} THEN '<mask>' ELSE s END), ' ')"


part("docs", f"SELECT doc_id, lang, source, text, {sents_sql('text')} AS sents FROM documents")
part("sent", "SELECT doc_id, unnest(range(len(sents)))::BIGINT AS sid, unnest(sents) AS sent FROM docs", "docs")
part("tok", f"SELECT doc_id, sid, unnest({toks_sql('sent')}) AS w FROM sent", "sent")
part("cnt", "SELECT doc_id, sid, w, count(*) AS c FROM tok GROUP BY ALL", "tok")
part("win", """SELECT *, sum(c) OVER (PARTITION BY doc_id, w)::BIGINT AS c_doc, sum(c) OVER (PARTITION BY doc_id, sid)::BIGINT AS n_sent,
  sum(c) OVER (PARTITION BY doc_id)::BIGINT AS n_doc FROM cnt""", "cnt")
part("nd", "SELECT doc_id, sum(c)::BIGINT AS n_doc FROM cnt GROUP BY doc_id", "cnt")
part("r1", """SELECT doc_id, sid, overlap, n_doc, CASE WHEN n_doc > 0 THEN round(2.0::DOUBLE * overlap / n_doc, 6) ELSE 0.0::DOUBLE END AS score FROM (
  SELECT s.doc_id, s.sid, coalesce(sum(least(c, c_doc - c)), 0)::BIGINT AS overlap, coalesce(any_value(nd.n_doc), 0)::BIGINT AS n_doc
  FROM sent s LEFT JOIN nd USING (doc_id) LEFT JOIN win w ON w.doc_id = s.doc_id AND w.sid = s.sid GROUP BY s.doc_id, s.sid)""", "sent nd win")
part("voc", "SELECT w, count(*)::BIGINT AS c_all FROM tok GROUP BY w", "tok")
part("tot", "SELECT sum(c_all)::DOUBLE AS total, count(*)::DOUBLE AS kinds FROM voc", "voc")
part("pmi", """SELECT s.doc_id, s.sid, coalesce(p.score, 0.0::DOUBLE) AS score FROM sent s LEFT JOIN pmi0 p USING (doc_id, sid)""", "sent pmi0")
part("pmi0", """SELECT doc_id, sid, round(CASE WHEN max(n_doc) = max(n_sent) THEN 0.0::DOUBLE ELSE
  sum(c * log2(((c_doc - c) + 64.0::DOUBLE * (c_all + 1.0::DOUBLE) / (total + kinds)) / (n_doc - n_sent + 64.0::DOUBLE)
  / ((c_all + 1.0::DOUBLE) / (total + kinds)))) / max(n_sent) END, 6) AS score
  FROM win JOIN voc USING (w) CROSS JOIN tot GROUP BY doc_id, sid""", "win voc tot")
part("seq", """SELECT doc_id, sid, w, row_number() OVER (PARTITION BY doc_id ORDER BY sid, p) AS g, p,
  lead(w) OVER (PARTITION BY doc_id ORDER BY sid, p) AS nw, lead(sid) OVER (PARTITION BY doc_id ORDER BY sid, p) AS ns
  FROM (SELECT doc_id, sid, unnest(toks) AS w, unnest(range(len(toks))) AS p
        FROM (SELECT doc_id, sid, """ + toks_sql("sent") + """ AS toks FROM sent))""", "sent")
part("r2", """SELECT s.doc_id, s.sid, coalesce(p.overlap, 0)::BIGINT AS overlap, coalesce(p.score, 0.0::DOUBLE) AS score FROM sent s LEFT JOIN r20 p USING (doc_id, sid)""", "sent r20")
part("r20", """SELECT s.doc_id, s.sid, coalesce(sum(least(o.c, greatest(d.c - o.c - (o.g = s.gb)::INT - (o.g = s.ga)::INT + (o.g = s.gj)::INT, 0))), 0)::BIGINT AS overlap,
  round(CASE WHEN n - 1 + greatest(nd - n - 1, 0) > 0 THEN
    2.0::DOUBLE * coalesce(sum(least(o.c, greatest(d.c - o.c - (o.g = s.gb)::INT - (o.g = s.ga)::INT + (o.g = s.gj)::INT, 0))), 0)
    / (n - 1 + greatest(nd - n - 1, 0)) ELSE 0.0::DOUBLE END, 6) AS score
  FROM (SELECT doc_id, sid, n, nd, coalesce(lag(l) OVER x || ' ' || f, '') AS gb, coalesce(l || ' ' || lead(f) OVER x, '') AS ga,
        coalesce(lag(l) OVER x || ' ' || lead(f) OVER x, '') AS gj
        FROM (SELECT doc_id, sid, count(*) AS n, arg_min(w, p) AS f, arg_max(w, p) AS l, sum(count(*)) OVER (PARTITION BY doc_id)::BIGINT AS nd
              FROM seq GROUP BY doc_id, sid) WINDOW x AS (PARTITION BY doc_id ORDER BY sid)) s
  LEFT JOIN (SELECT doc_id, sid, w || ' ' || nw AS g, count(*) AS c FROM seq WHERE ns = sid GROUP BY ALL) o USING (doc_id, sid)
  LEFT JOIN (SELECT doc_id, w || ' ' || nw AS g, count(*) AS c FROM seq WHERE nw IS NOT NULL GROUP BY ALL) d ON d.doc_id = o.doc_id AND d.g = o.g
  GROUP BY s.doc_id, s.sid, n, nd""", "seq")
for _m, _t in (("a", "r1"), ("b", "pmi"), ("c", "r2")):
    part(f"sel_{_m}", f"SELECT doc_id, arg_min(sid, sid) AS sid, any_value(score) AS score FROM (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY score DESC, sid) AS k FROM {_t}) WHERE k = 1 GROUP BY doc_id", _t)
part("pred", f"""SELECT d.doc_id, lang AS dataset, source AS checkpoint, text, sents, sents[1] AS reference, a.sid AS sid_a, b.sid AS sid_b,
  sents[a.sid + 1] AS summary_a, sents[b.sid + 1] AS summary_b FROM docs d JOIN sel_a a USING (doc_id) JOIN sel_b b USING (doc_id)""",
     "docs sel_a sel_b")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def selections(docs: DataFrame) -> DataFrame:
    """``doc_id, sid_a, sid_b`` from one pass over the token counts."""
    return scoring.overlap_and_pmi(docs).groupBy("doc_id").agg(
        select.first_best("rouge1").alias("sid_a"), select.first_best("pmi").alias("sid_b"))


def predictions(spark: SparkSession, sf: str, with_text: bool = False) -> DataFrame:
    """One row per document that has words: reference and both systems' summaries."""
    docs = documents(spark, sf)
    rows = docs.select("doc_id", "text", "lang", "source").join(selections(docs), "doc_id").withColumn("sents", tx.sentences(F.col("text")))
    pick = lambda sid: F.get("sents", F.col(sid).cast("int"))
    return rows.select(
        "doc_id", F.col("lang").alias("dataset"), F.col("source").alias("checkpoint"),
        *(["text", "sents"] if with_text else []),
        F.get("sents", F.lit(0)).alias("reference"), "sid_a", "sid_b",
        pick("sid_a").alias("summary_a"), pick("sid_b").alias("summary_b"))
