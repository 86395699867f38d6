"""Queries on sentence scores and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from salience.functions import text as tx
from salience.operators import scoring, select, vectors
from salience.operators.scale import even_join, written
from salience.operators.sentences import corpus_counts, sentence_rows, token_counts
from salience.plans.derive import documents, masked_sql
from salience.plans.registry import part, query, table


@query("rouge1_pairs", f"""SELECT doc_id, sid, score, {masked_sql('sents', 'sid')} AS document, sents[sid + 1] AS summary
  FROM docs JOIN sel_a USING (doc_id)""", "docs sel_a")
def rouge1_pairs(spark, sf):
    return select.pairs_in_row(scoring.rouge1_list(documents(spark, sf)))


@query("rouge1_scores", "SELECT doc_id, sid, overlap, n_doc, score FROM r1", "r1")
def rouge1_scores(spark, sf):
    return scoring.rouge1(documents(spark, sf))


@query("rouge2_scores", "SELECT doc_id, sid, overlap, score FROM r2", "r2")
def rouge2_scores(spark, sf):
    return scoring.rouge2(documents(spark, sf))


@query("count_pmi_scores", "SELECT doc_id, sid, score FROM pmi", "pmi")
def count_pmi_scores(spark, sf):
    return scoring.count_pmi(documents(spark, sf))


@query("rougeL_scores", """SELECT s.doc_id, s.sid, coalesce(l.lcs, 0)::BIGINT AS lcs, CASE WHEN coalesce(n_doc, 0) > 0 THEN round(2.0::DOUBLE * coalesce(l.lcs, 0) / n_doc, 6) ELSE 0.0::DOUBLE END AS score
  FROM sent s LEFT JOIN nd USING (doc_id) LEFT JOIN (
    SELECT doc_id, sid, len(list_reduce(list_prepend([]::BIGINT[], places), lambda a, x:
      a[1:len(list_filter(a, lambda t: t < x[1]))] || x || a[len(list_filter(a, lambda t: t < x[1])) + 2:])) AS lcs FROM (
      SELECT x.doc_id, x.sid, list([x.p::BIGINT] ORDER BY y.g, x.p DESC) AS places FROM seq x JOIN seq y ON y.doc_id = x.doc_id AND y.w = x.w AND y.sid <> x.sid GROUP BY ALL)) l USING (doc_id, sid)""", "sent nd seq")
def rouge_l_scores(spark, sf):
    return scoring.rouge_l(documents(spark, sf))


# ---- selection --------------------------------------------------------------------------------------------------

part("top5", "SELECT * FROM (SELECT doc_id, sid, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, sid) AS rank FROM r1) WHERE rank <= 5", "r1")


@query("top_sentences", "SELECT doc_id, sid, score, rank FROM top5", "top5")
def top_sentences(spark, sf):
    return select.top_k(scoring.rouge1(documents(spark, sf))).select("doc_id", "sid", "score", "rank")


@query("combined_candidates", f"""SELECT doc_id, sid, score, {masked_sql('sents', 'sid')} AS document, sents[sid + 1] AS summary FROM docs JOIN sel_a USING (doc_id)""", "docs sel_a")
def combined_candidates(spark, sf):
    docs = documents(spark, sf)
    return select.combine_candidates(select.candidate_lists(docs, scoring.rouge1(docs)))


@query("fused_candidates", """SELECT doc_id, arg_min(sid, k) AS sid, arg_min(fused, k) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY fused DESC, sid) AS k FROM (
    SELECT doc_id, sid, score + CASE WHEN ('0x' || substr(md5(doc_id || ':' || sid), 1, 1))::BIGINT % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS fused FROM top5)) GROUP BY doc_id""", "top5")
def fused_candidates(spark, sf):
    docs = documents(spark, sf)
    lists = select.candidate_lists(docs, scoring.rouge1(docs))
    labels = F.transform("sids", lambda s: tx.hex_number(tx.keyed_digest(F.col("doc_id"), s), 1, 1) % 2)
    return select.combine_candidates(lists.withColumn("labels", labels), "labels").select("doc_id", "sid", "score")


@query("direct_selection", f"""SELECT d.doc_id, b.sid, CASE WHEN b.sid IS NULL THEN '' ELSE {masked_sql('sents', 'b.sid')} END AS document, coalesce(sents[b.sid + 1], '') AS summary
  FROM docs d LEFT JOIN sel_b b USING (doc_id)""", "docs sel_b")
def direct_selection(spark, sf):
    docs = documents(spark, sf)
    return select.masked_pairs(docs, select.best(scoring.count_pmi(docs)).select("doc_id", "sid"))


@query("seeded_subset", """SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('subset:' || lang || ':' || doc_id), doc_id) AS k FROM documents) WHERE k <= 50""")
def seeded_subset(spark, sf):
    return select.seeded_subset(documents(spark, sf).select("doc_id", "lang", "source"), "lang", "doc_id", 50)


# ---- likelihoods, hashed contexts and vectors ----------------------------------------------------------------------

part("nll", """SELECT doc_id, sid, kind, CASE kind WHEN 'cond' THEN -ln(c_doc::DOUBLE / n_doc) WHEN 'marg' THEN -ln(c_all::DOUBLE / total) ELSE ln(kinds) END AS nll
  FROM win JOIN voc USING (w) CROSS JOIN tot, (VALUES ('cond'), ('marg'), ('base')) k(kind), range(c)""", "win voc tot")


def token_nll(spark, sf):
    """Per-token likelihoods of count models: the document's words, the corpus's words, and a flat model."""
    docs = documents(spark, sf)
    vocabulary = written(corpus_counts(docs), "vocabulary")
    total, kinds = vocabulary.select(F.sum("c_all")).scalar(), vocabulary.select(F.count("*")).scalar()
    rows = even_join(token_counts(docs), vocabulary.withColumn("_w", F.col("c_all")), ["w"], "_w", 100_000)
    kind = lambda name, x: F.struct(F.lit(name).alias("kind"), x.alias("nll"))
    three = F.array(kind("cond", -F.log(F.col("c_doc").cast("double") / F.col("n_doc"))),
                    kind("marg", -F.log(F.col("c_all").cast("double") / total)), kind("base", F.log(kinds.cast("double"))))
    repeated = rows.select("doc_id", "sid", F.explode(F.flatten(F.array_repeat(three, F.col("c").cast("int")))).alias("x"))
    return repeated.select("doc_id", "sid", "x.*")


@query("likelihood_pmi", """SELECT doc_id, sid, round(exp(-c), 6) AS p_cond, round(exp(-m), 6) AS p_marg, round((m - c) / ln(2.0::DOUBLE), 6) AS score FROM (
  SELECT doc_id, sid, avg(nll) FILTER (WHERE kind = 'cond') AS c, avg(nll) FILTER (WHERE kind = 'marg') AS m FROM nll GROUP BY ALL)""", "nll")
def likelihood_pmi(spark, sf):
    return scoring.likelihood_pmi(token_nll(spark, sf))


@query("baseline_pmi_per_token", """SELECT doc_id, sid, round((avg(nll) FILTER (WHERE kind = 'base') - avg(nll) FILTER (WHERE kind = 'cond')) / ln(2.0::DOUBLE), 6) AS score FROM nll GROUP BY ALL""", "nll")
def baseline_pmi_per_token(spark, sf):
    return scoring.baseline_pmi(token_nll(spark, sf))


@query("baseline_pmi_total", """SELECT doc_id, sid, round((sum(nll) FILTER (WHERE kind = 'base') - sum(nll) FILTER (WHERE kind = 'cond')) / ln(2.0::DOUBLE), 6) AS score FROM nll GROUP BY ALL""", "nll")
def baseline_pmi_total(spark, sf):
    return scoring.baseline_pmi(token_nll(spark, sf), per_token=False)


part("hb", "SELECT doc_id, sid, ('0x' || substr(md5(w), 1, 4))::BIGINT % 64 AS b, sum(c)::DOUBLE AS c FROM cnt GROUP BY ALL", "cnt")
part("hd", "SELECT doc_id, b, sum(c) AS t FROM hb GROUP BY ALL", "hb")


HASHED = """SELECT s.doc_id, s.sid, round(CASE WHEN sum(r.x * r.x) > 0 AND sum(coalesce(h.c, 0) * coalesce(h.c, 0)) > 0 THEN sum(coalesce(h.c, 0) * r.x) / sqrt(sum(coalesce(h.c, 0) * coalesce(h.c, 0)) * sum(r.x * r.x)) ELSE 0.0::DOUBLE END, 6) AS score
  FROM sent s LEFT JOIN (SELECT k.doc_id, k.sid, d.b, d.t - coalesce(h.c, 0) AS x FROM sent k
  JOIN hd d USING (doc_id) LEFT JOIN hb h ON h.doc_id = k.doc_id AND h.sid = k.sid AND h.b = d.b) r ON r.doc_id = s.doc_id AND r.sid = s.sid
  LEFT JOIN hb h ON h.doc_id = s.doc_id AND h.sid = s.sid AND h.b = r.b GROUP BY s.doc_id, s.sid"""


@query("hashed_context_similarity", HASHED, "hb hd sent")
def hashed_context_similarity(spark, sf):
    return scoring.hashed_context_similarity(documents(spark, sf))


DIMS = 64
part("vec", """SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings""")
part("velem", "SELECT vec_id, label, unnest(v) AS x, unnest(range(64)) AS i FROM vec", "vec")


@query("vector_salience", """SELECT label::BIGINT AS label, vec_id, round(sum(x * r) / sqrt(sum(r * r)), 6) AS score FROM (
  SELECT label, vec_id, x, (sum(x) OVER (PARTITION BY label, i) - x) / (count(*) OVER (PARTITION BY label, i) - 1) AS r FROM velem) GROUP BY ALL""", "velem")
def vector_salience(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("label"), "vec_id", F.col("embedding").alias("v"))
    return vectors.salience(v, "label", "vec_id", DIMS)


@query("others_sums", """SELECT label::BIGINT AS label, vec_id, i::BIGINT AS dim, round(sum(x) OVER (PARTITION BY label, i) - x, 6) AS rest FROM (
  SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings)""")
def others_sums(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("label"), "vec_id", vectors.as_doubles("embedding").alias("v"))
    sums = e.groupBy("label").agg(vectors.vector_sum("v", DIMS).alias("s"), F.count("*").alias("_w"))
    rest = F.zip_with("s", "v", lambda s, x: tx.r6(s - x))
    return even_join(e, sums, ["label"], "_w").select("label", "vec_id", F.posexplode(rest).alias("dim", "rest")).withColumn("dim", F.col("dim").cast("long"))


@query("pooled_vectors", """SELECT id, i::BIGINT AS dim, round(m / sqrt(sum(m * m) OVER (PARTITION BY id)), 6) AS x FROM (
  SELECT vec_id // 10 AS id, i, avg(x) AS m FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings) WHERE vec_id % 10 < 7 GROUP BY ALL)""")
def pooled_vectors(spark, sf):
    t = table(spark, sf, "embeddings").select(F.expr("vec_id div 10").alias("id"), (F.col("vec_id") % 10 < 7).alias("mask"), F.col("embedding").alias("v"))
    return vectors.pooled(t, "id", DIMS).select("id", F.posexplode("v").alias("dim", "x")).select("id", F.col("dim").cast("long").alias("dim"), tx.r6(F.col("x")).alias("x"))


part("tokv", "SELECT vec_id // 20 AS pair_id, CASE WHEN vec_id % 20 < 10 THEN 'cand' ELSE 'ref' END AS side, vec_id, v FROM vec WHERE vec_id % 10 <> 0", "vec")
MATCH = """SELECT pair_id, {s}(p) AS precision, {s}(r) AS recall, {s}(2 * p * r / (p + r + 1e-8::DOUBLE)) AS f1 FROM (
  SELECT pair_id, avg(x) AS p FROM (SELECT c.pair_id, c.vec_id, max(list_dot_product(c.v, r.v)) AS x FROM tokv c JOIN tokv r ON c.pair_id = r.pair_id AND c.side = 'cand' AND r.side = 'ref' GROUP BY ALL) GROUP BY pair_id) JOIN (
  SELECT pair_id, avg(x) AS r FROM (SELECT r.pair_id, r.vec_id, max(list_dot_product(c.v, r.v)) AS x FROM tokv c JOIN tokv r ON c.pair_id = r.pair_id AND c.side = 'cand' AND r.side = 'ref' GROUP BY ALL) GROUP BY pair_id) USING (pair_id)"""


def token_vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.expr("vec_id div 20").alias("pair_id"), F.when(F.col("vec_id") % 20 < 10, "cand").otherwise("ref").alias("side"),
        (F.col("vec_id") % 10).alias("pos"), (F.col("vec_id") % 10 == 0).alias("special"), F.col("embedding").alias("v"))


@query("greedy_match", "SELECT pair_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM (" + MATCH.replace("{s}", "") + ")", "tokv")
def greedy_match(spark, sf):
    return vectors.greedy_match(token_vectors(spark, sf))


@query("greedy_match_rescaled", "SELECT pair_id, round((precision - 0.1) / 0.9::DOUBLE, 6) AS precision, round((recall - 0.1) / 0.9::DOUBLE, 6) AS recall, round((f1 - 0.1) / 0.9::DOUBLE, 6) AS f1 FROM (" + MATCH.replace("{s}", "") + ")", "tokv")
def greedy_match_rescaled(spark, sf):
    return vectors.greedy_match(token_vectors(spark, sf), baseline=0.1)


@query("encoded_sentences", """SELECT s.doc_id || ':' || s.sid AS id, h.b::BIGINT AS dim, round(h.c / sqrt(sum(h.c * h.c) OVER (PARTITION BY s.doc_id, s.sid)), 6) AS x
  FROM sent s JOIN hb h USING (doc_id, sid)""", "sent hb")
def encoded_sentences(spark, sf):
    rows = sentence_rows(documents(spark, sf)).select(F.concat_ws(":", "doc_id", "sid").alias("id"), "sent")
    made = vectors.encode_texts(rows, "id", "sent", vectors.hashed_bag_encoder)
    parts = made.select("id", F.posexplode("v").alias("dim", "x")).filter("x <> 0")
    return parts.select("id", F.col("dim").cast("long").alias("dim"), tx.r6(F.col("x")).alias("x"))


@query("encoded_context_similarity", HASHED, "hb hd sent")
def encoded_context_similarity(spark, sf):
    return vectors.encoded_context_similarity(documents(spark, sf), vectors.hashed_bag_encoder)


@query("distinct_contexts", "SELECT sha256(text) AS context_hash, any_value(text) AS text, count(*) AS copies FROM documents GROUP BY text")
def distinct_contexts(spark, sf):
    return vectors.distinct_contexts(documents(spark, sf), "text")


@query("scored_once", "SELECT doc_id, length(text) AS n, sha256(text) AS context_hash FROM documents")
def scored_once(spark, sf):
    count = lambda d: d.select("context_hash", F.length("text").cast("long").alias("n"))
    return vectors.score_once(documents(spark, sf).select("doc_id", "text"), "text", count).select("doc_id", "n", "context_hash")
