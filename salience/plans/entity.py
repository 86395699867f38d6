"""Queries on entities, repair and negatives. The first sentence is the summary, the others are the document."""

from __future__ import annotations

from pyspark.sql import functions as F

from salience.functions import entities as en
from salience.functions import text as tx
from salience.operators import entities as ops
from salience.plans.derive import documents
from salience.plans.registry import part, query

SPAN = en.SPAN
TYPE = r"""CASE WHEN regexp_matches({x}, '^[$€£]') THEN 'MONEY' WHEN suffix({x}, '%') THEN 'PERCENT' WHEN regexp_matches({x}, '^(19|20)[0-9][0-9]$') THEN 'DATE'
  WHEN regexp_matches({x}, '^[0-9]') THEN 'CARDINAL' WHEN len(string_split({x}, ' ')) = 1 THEN 'GPE' WHEN len(string_split({x}, ' ')) = 2 THEN 'PERSON' ELSE 'ORG' END"""
CAT = "CASE WHEN {x} IN ('PERCENT', 'MONEY', 'QUANTITY', 'CARDINAL') THEN 'number' WHEN {x} IN ('DATE', 'TIME') THEN 'date' ELSE 'entity' END"

part("fine", "SELECT doc_id, sents[1] AS summary, array_to_string(sents[2:], ' ') AS document FROM docs WHERE len(sents) > 0", "docs")


def ent_part(name: str, source: str, column: str) -> None:
    part(name, f"""SELECT doc_id, k::BIGINT AS k, m AS text, lo, lo + length(m) AS hi, string_split(m, ' ') AS tokens, {TYPE.replace('{x}', 'm')} AS ent_type FROM (
      SELECT doc_id, k, m, (sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) - length(m))::BIGINT AS lo FROM (
        SELECT doc_id, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS k FROM (
          SELECT doc_id, regexp_extract_all({column}, '{SPAN}') AS ms, regexp_split_to_array({column}, '{SPAN}') AS gs FROM {source})))""", source)


ent_part("sume", "fine", "summary")
part("withsum", "SELECT * FROM fine WHERE doc_id IN (SELECT doc_id FROM sume)", "fine sume")
ent_part("doce", "withsum", "document")
part("sumc", f"SELECT *, {CAT.replace('{x}', 'ent_type')} AS category FROM sume", "sume")
part("docc", f"SELECT *, {CAT.replace('{x}', 'ent_type')} AS category FROM doce", "doce")
part("dknown", "SELECT doc_id, list_distinct(list_concat(list(text), flatten(list(tokens)))) AS known FROM doce GROUP BY doc_id", "doce")
part("unsup", """SELECT s.* FROM sume s LEFT JOIN dknown d USING (doc_id) WHERE NOT (coalesce(list_contains(d.known, s.text), false) OR coalesce(list_has_all(d.known, s.tokens), false))""", "sume dknown")


def pairs(spark, sf):
    d = documents(spark, sf).select("doc_id", tx.sentences(F.col("text")).alias("s")).filter(F.size("s") > 0)
    return d.select("doc_id", F.get("s", F.lit(0)).alias("summary"), F.array_join(F.slice("s", F.lit(2), F.size("s")), " ").alias("document"))


def annotated(spark, sf):
    return ops.annotate(pairs(spark, sf))


def parsed(spark, sf):
    return ops.with_simple_tokens(annotated(spark, sf))


@query("entity_annotation", """SELECT doc_id, 'summary' AS side, k, text, lo AS start_idx, hi AS end_idx, ent_type FROM sume
  UNION ALL SELECT doc_id, 'document', k, text, lo, hi, ent_type FROM doce""", "sume doce")
def entity_annotation(spark, sf):
    a = annotated(spark, sf)
    side = lambda name: F.transform(f"{name}_ents", lambda e, k: F.struct(F.lit(name).alias("side"), k.cast("long").alias("k"), e.alias("e")))
    both = a.select("doc_id", F.explode(F.concat(side("summary"), side("document"))).alias("x"))
    return both.select("doc_id", "x.side", "x.k", "x.e.text", "x.e.start_idx", "x.e.end_idx", "x.e.ent_type")


@query("gated_annotation", """SELECT doc_id, (SELECT count(*) FROM sume s WHERE s.doc_id = f.doc_id) AS n_summary, (SELECT count(*) FROM doce d WHERE d.doc_id = f.doc_id) AS n_document FROM fine f""", "fine sume doce")
def gated_annotation(spark, sf):
    return annotated(spark, sf).select("doc_id", F.size("summary_ents").cast("long").alias("n_summary"), F.size("document_ents").cast("long").alias("n_document"))


@query("entity_categories", "SELECT category, ent_type, count(*) AS n FROM docc GROUP BY ALL", "docc")
def entity_categories(spark, sf):
    e = annotated(spark, sf).select(F.explode("document_ents").alias("e"))
    return e.groupBy(en.category(F.col("e.ent_type")).alias("category"), F.col("e.ent_type").alias("ent_type")).agg(F.count("*").alias("n"))


@query("unsupported_entities", "SELECT doc_id, string_agg(k::VARCHAR, ',' ORDER BY k DESC) AS ids FROM unsup GROUP BY doc_id", "unsup")
def unsupported_entities(spark, sf):
    u = ops.unsupported_ids(annotated(spark, sf)).filter(F.size("unsupported") > 0)
    return u.select("doc_id", F.array_join(F.transform("unsupported", lambda i: i.cast("string")), ",").alias("ids"))


part("fact", """SELECT s.* FROM sumc s WHERE EXISTS (SELECT 1 FROM docc d WHERE d.doc_id = s.doc_id AND d.category = s.category AND (list_has_all(d.tokens, s.tokens) OR list_has_all(s.tokens, d.tokens)))""", "sumc docc")


@query("supported_entities", "SELECT doc_id, k, text, category FROM fact", "fact")
def supported_entities(spark, sf):
    f = annotated(spark, sf).select("doc_id", "document_ents", F.posexplode("summary_ents").alias("k", "e"))
    return f.filter(en.supported_by(F.col("e"), F.col("document_ents"))).select(
        "doc_id", F.col("k").cast("long").alias("k"), "e.text", en.category(F.col("e.ent_type")).alias("category"))


@query("first_replacements", """SELECT u.doc_id, u.k, u.text, arg_min(d.text, d.k) AS replacement FROM unsup u LEFT JOIN doce d ON d.doc_id = u.doc_id AND list_has_all(u.tokens, d.tokens) GROUP BY ALL""", "unsup doce")
def first_replacements(spark, sf):
    u = ops.unsupported_ids(annotated(spark, sf)).select("doc_id", "summary_ents", "document_ents", F.explode("unsupported").alias("k"))
    e = F.get("summary_ents", F.col("k"))
    return u.select("doc_id", F.col("k").cast("long").alias("k"), e["text"].alias("text"), en.first_replacement(e, F.col("document_ents"))["text"].alias("replacement"))


@query("entity_dictionary", "SELECT DISTINCT category, unnest(tokens) AS word FROM docc", "docc")
def entity_dictionary(spark, sf):
    return ops.dictionary(annotated(spark, sf))


@query("document_dictionaries", "SELECT doc_id, category, string_agg(DISTINCT w, ' ' ORDER BY w) AS words FROM (SELECT doc_id, category, unnest(tokens) AS w FROM docc) GROUP BY ALL", "docc")
def document_dictionaries(spark, sf):
    d = annotated(spark, sf).select("doc_id", F.explode(ops.document_dictionary(F.col("document_ents"))).alias("category", "words"))
    return d.filter(F.size("words") > 0).select("doc_id", "category", F.array_join("words", " ").alias("words"))


@query("replaced_summaries", """SELECT f.doc_id, coalesce(r.summary, f.summary) AS summary FROM fine f LEFT JOIN (
  SELECT doc_id, string_agg(gap || piece, '' ORDER BY k) || substr(any_value(full_text), max(hi) + 1) AS summary FROM (
    SELECT s.doc_id, s.k, s.hi, f.summary AS full_text, substr(f.summary, coalesce(lag(s.hi) OVER w, 0) + 1, s.lo - coalesce(lag(s.hi) OVER w, 0)) AS gap, coalesce(x.new, s.text) AS piece
    FROM sume s JOIN fine f USING (doc_id) LEFT JOIN (SELECT u.doc_id, u.k, arg_min(d.text, d.k) AS new FROM unsup u JOIN doce d ON d.doc_id = u.doc_id AND list_has_all(u.tokens, d.tokens) GROUP BY ALL) x ON x.doc_id = s.doc_id AND x.k = s.k
    WINDOW w AS (PARTITION BY s.doc_id ORDER BY s.k)) GROUP BY doc_id) r USING (doc_id)""", "fine sume unsup doce")
def replaced_summaries(spark, sf):
    return ops.corrected(parsed(spark, sf), "replace").select("doc_id", "summary")


def repair_parts(mode: str, replaces: bool) -> None:
    """Removal as a recursion over the entities' tokens, one a step, from lists of links and relations of the rule-made tree.

    Below a word are the links that follow it without a gap; above a link is the word before it.
    """
    new = """SELECT s.*, (u.k IS NOT NULL) AS open, arg_min(d.text, d.k) AS new FROM sume s LEFT JOIN unsup u USING (doc_id, k)
      LEFT JOIN doce d ON d.doc_id = u.doc_id AND list_has_all(u.tokens, d.tokens) GROUP BY ALL""" if replaces else \
        "SELECT s.*, (u.k IS NOT NULL) AS open, NULL::VARCHAR AS new FROM sume s LEFT JOIN unsup u USING (doc_id, k)"
    part(f"ent_{mode}", f"""SELECT *, open AND new IS NULL AS loose, coalesce(sum(change) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS shift FROM (
      SELECT x.* EXCLUDE (doc_id, tokens), x.doc_id, len(x.tokens) AS n, coalesce(length(new) - (hi - lo), 0) AS change,
        lo - length(replace(left(f.summary, lo), ' ', '')) AS i0 FROM ({new.replace("SELECT s.*,", "SELECT s.doc_id, s.k, s.text, s.lo, s.hi, s.tokens,")}) x JOIN fine f USING (doc_id))""", "sume unsup doce fine")
    part(f"text_{mode}", f"""SELECT f.doc_id, coalesce(r.summary, f.summary) AS summary FROM fine f LEFT JOIN (
      SELECT doc_id, string_agg(gap || piece, '' ORDER BY k) || substr(any_value(whole), max(hi) + 1) AS summary FROM (
        SELECT e.doc_id, e.k, e.hi, f.summary AS whole, substr(f.summary, coalesce(lag(e.hi) OVER w, 0) + 1, e.lo - coalesce(lag(e.hi) OVER w, 0)) AS gap, coalesce(e.new, e.text) AS piece
        FROM ent_{mode} e JOIN fine f USING (doc_id) WINDOW w AS (PARTITION BY e.doc_id ORDER BY e.k)) GROUP BY doc_id) r USING (doc_id)""", f"ent_{mode} fine")
    part(f"word_{mode}", f"""SELECT t.doc_id, t.i, t.w, t.link, t.at + coalesce((SELECT sum(change) FROM ent_{mode} e WHERE e.doc_id = t.doc_id AND e.new IS NOT NULL AND e.i0 + e.n - 1 < t.i), 0)::BIGINT AS idx, t.size,
      CASE WHEN EXISTS (SELECT 1 FROM ent_{mode} e WHERE e.doc_id = t.doc_id AND e.new IS NOT NULL AND t.i BETWEEN e.i0 AND e.i0 + e.n - 1) THEN 'fixed' ELSE t.dep END AS dep FROM ruled t""", f"ent_{mode} ruled")
    part(f"tree_{mode}", f"SELECT doc_id, count(*) AS n, list(dep ORDER BY i) AS deps, list(link ORDER BY i) AS links FROM word_{mode} GROUP BY doc_id", f"word_{mode}")
    part(f"aims_{mode}", f"""SELECT doc_id, list(t ORDER BY k DESC, t) AS ts FROM (SELECT doc_id, k, unnest(range(i0, i0 + n)) AS t FROM ent_{mode} WHERE loose) GROUP BY doc_id""", f"ent_{mode}")
    part(f"steps_{mode}", f"""SELECT doc_id, 0::BIGINT AS step, []::BIGINT[] AS gone FROM aims_{mode}
      UNION ALL SELECT doc_id, step + 1, CASE WHEN deps[t + 1] IN ('pobj', 'prep') AND len(list_filter(range(t + 1, below), lambda j: deps[j + 1] <> 'fixed' AND NOT list_contains(own, j))) = 0
        THEN own || range(above + 1, t) ELSE own END FROM (
        SELECT *, gone || [t] || list_filter(CASE WHEN t = 0 THEN list_filter(range(1, n), lambda j: NOT links[j + 1] OR j = 1)
            WHEN t + 1 < n AND links[t + 2] THEN [t + 1] ELSE [] END, lambda j: deps[j + 1] NOT IN ('compound', 'relcl', 'fixed')) AS own,
          coalesce(list_min(list_filter(range(t + 1, n), lambda j: NOT links[j + 1])), n) AS below,
          coalesce(list_max(list_filter(range(0, t), lambda j: deps[j + 1] NOT IN ('pobj', 'prep'))), -1) AS above
        FROM (SELECT s.*, a.ts[step + 1] AS t, r.n, r.deps, r.links FROM steps_{mode} s JOIN aims_{mode} a USING (doc_id) JOIN tree_{mode} r USING (doc_id) WHERE step < len(a.ts)))""", f"aims_{mode} tree_{mode}")
    part(f"gone_{mode}", f"SELECT doc_id, arg_max(gone, step) AS gone FROM steps_{mode} GROUP BY doc_id", f"steps_{mode}")
    part(f"cut_{mode}", f"""SELECT w.*, list_contains(coalesce(g.gone, []), w.i) AS cut,
      coalesce(sum(CASE WHEN list_contains(coalesce(g.gone, []), w.i) THEN w.size ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lost
      FROM word_{mode} w LEFT JOIN gone_{mode} g USING (doc_id)""", f"word_{mode} gone_{mode}")
    part(f"left_{mode}", f"""SELECT t.doc_id, t.summary AS before, array_to_string(list_transform(range(0, length(t.summary)), lambda p:
        CASE WHEN len(list_filter(coalesce(c.cuts, []), lambda x: p >= x.lo AND p < x.hi)) > 0 THEN '' ELSE t.summary[p + 1] END), '') AS summary
      FROM text_{mode} t LEFT JOIN (SELECT doc_id, list({{'lo': idx, 'hi': idx + size}}) AS cuts FROM cut_{mode} WHERE cut GROUP BY doc_id) c USING (doc_id)""", f"text_{mode} cut_{mode}")
    part(f"ents_{mode}", f"""SELECT e.doc_id, string_agg(coalesce(e.new, e.text) || ':' || (e.lo + e.shift - c.lost) || ':' || (e.hi + e.shift + e.change - c.lost), ',' ORDER BY e.k) AS ents
      FROM ent_{mode} e JOIN cut_{mode} c ON c.doc_id = e.doc_id AND c.i = e.i0
      WHERE NOT e.loose AND NOT EXISTS (SELECT 1 FROM cut_{mode} x WHERE x.doc_id = e.doc_id AND x.cut AND x.i BETWEEN e.i0 AND e.i0 + e.n - 1) GROUP BY e.doc_id""", f"ent_{mode} cut_{mode}")
    part(f"toks_{mode}", f"SELECT doc_id, string_agg(i || ':' || (idx - lost) || ':' || dep, ',' ORDER BY i) AS tokens FROM cut_{mode} WHERE NOT cut GROUP BY doc_id", f"cut_{mode}")


part("ruled", r"""SELECT *, CASE WHEN i = 0 THEN 'ROOT' WHEN prep THEN 'prep' WHEN link THEN 'pobj' WHEN regexp_matches(w, '^\p{Lu}') THEN 'compound' ELSE 'dobj' END AS dep FROM (
  SELECT *, i > 0 AND (prep OR coalesce(lag(prep) OVER (PARTITION BY doc_id ORDER BY i), false)) AS link,
    (sum(size) OVER (PARTITION BY doc_id ORDER BY i) - size)::BIGINT AS at FROM (
    SELECT doc_id, i, w, i > 0 AND regexp_matches(w, '^\p{Ll}{1,3}$') AS prep, length(w) + (i < n - 1)::INT AS size FROM (
      SELECT doc_id, unnest(string_split(summary, ' ')) AS w, unnest(range(len(string_split(summary, ' ')))) AS i, len(string_split(summary, ' ')) AS n FROM fine)))""", "fine")
repair_parts("all", True)
repair_parts("remove", False)
REPAIRED = """SELECT doc_id, {text} AS summary, (l.summary <> l.before)::INT::BIGINT AS corrected, coalesce(e.ents, '') AS ents, coalesce(t.tokens, '') AS tokens
  FROM left_{mode} l LEFT JOIN ents_{mode} e USING (doc_id) LEFT JOIN toks_{mode} t USING (doc_id)"""


def shown(rows):
    """Repaired rows with the offsets of entities and tokens that are left."""
    ents = F.transform("summary_ents", lambda e: F.concat_ws(":", e["text"], e["start_idx"], e["end_idx"]))
    tokens = F.transform("summary_tokens", lambda t: F.concat_ws(":", t["i"], t["idx"], t["dep"]))
    return rows.select("doc_id", "summary", "corrected", F.array_join(ents, ",").alias("ents"), F.array_join(tokens, ",").alias("tokens"))


@query("repaired_summaries", REPAIRED.format(mode="all", text="upper(left(l.summary, 1)) || substr(l.summary, 2)").replace("(l.summary <> l.before)", "(upper(left(l.summary, 1)) || substr(l.summary, 2) <> l.before)"),
       "left_all ents_all toks_all", recursive=True)
def repaired_summaries(spark, sf):
    return shown(ops.corrected(parsed(spark, sf), "all"))


@query("reduced_summaries", REPAIRED.format(mode="remove", text="l.summary"), "left_remove ents_remove toks_remove", recursive=True)
def reduced_summaries(spark, sf):
    return shown(ops.corrected(parsed(spark, sf), "remove", lowercase=True))


DRAW = "('0x' || substr(md5({k}), 1, 8))::BIGINT"


def draw(k: str) -> str:
    return DRAW.replace("{k}", k)


NO_TOKEN = "len(list_filter({t}, lambda t: contains({w}, t))) = 0"


def no_token(t: str, w: str) -> str:
    return NO_TOKEN.replace("{t}", t).replace("{w}", w)


part("ipool", "SELECT doc_id, category, list(w ORDER BY w) AS pool FROM (SELECT DISTINCT doc_id, category, unnest(tokens) AS w FROM docc) GROUP BY ALL", "docc")
part("ielig", f"""SELECT f.doc_id, list(f ORDER BY f.k) AS es FROM fact f JOIN ipool p USING (doc_id, category) WHERE len(list_filter(p.pool, lambda w: {no_token('f.tokens', 'w')})) > 0 GROUP BY f.doc_id""", "fact ipool")
part("iword", f"""SELECT c.doc_id, r, e, arg_min(w, t) FILTER (WHERE {no_token('e.tokens', 'w')}) AS word FROM (
  SELECT c.doc_id, c.r, c.e, t, p.pool[1 + {draw("'word:' || c.doc_id || ':' || r || ':' || t")} % len(p.pool)] AS w FROM (
    SELECT doc_id, r, es[1 + {draw("'ent:' || doc_id || ':' || r")} % len(es)] AS e FROM ielig, range(2) z(r)) c JOIN ipool p ON p.doc_id = c.doc_id AND p.category = c.e.category, range(10) y(t)) c GROUP BY ALL""", "ielig ipool")
WRITE = """SELECT w.doc_id, r::BIGINT AS r, left(f.summary, e.lo) || word || substr(f.summary, e.hi + 1) AS negative FROM {p} w JOIN fine f USING (doc_id)
  WHERE w.doc_id NOT IN (SELECT doc_id FROM {p} WHERE word IS NULL)"""


@query("intrinsic_negatives", WRITE.replace("{p}", "iword"), "iword fine")
def intrinsic_negatives(spark, sf):
    return ops.intrinsic_negatives(annotated(spark, sf), 2)


part("epool", "SELECT category, w, row_number() OVER (PARTITION BY category ORDER BY md5(w), w) - 1 AS idx FROM (SELECT DISTINCT category, unnest(tokens) AS w FROM docc)", "docc")
part("esize", "SELECT category, count(*) AS n FROM epool GROUP BY category", "epool")
part("avoid", "SELECT doc_id, list(DISTINCT w) AS avoid FROM (SELECT doc_id, unnest(tokens) AS w FROM doce) GROUP BY doc_id", "doce")
part("eelig", f"""SELECT f.doc_id, list(f ORDER BY f.k) AS es FROM fact f WHERE EXISTS (SELECT 1 FROM epool z WHERE z.category = f.category AND {no_token('f.tokens', 'z.w')}) GROUP BY f.doc_id""", "fact epool")
part("eword", f"""SELECT doc_id, r, e, arg_min(w, t) FILTER (WHERE {no_token('e.tokens', 'w')} AND len(list_filter(avoid, lambda a: contains(w, a) OR contains(a, w))) = 0) AS word FROM (
  SELECT c.doc_id, c.r, c.e, t, q.w, a.avoid FROM (SELECT doc_id, r, es[1 + {draw("'ent:' || doc_id || ':' || r")} % len(es)] AS e FROM eelig, range(2) z(r)) c
  CROSS JOIN range(10) y(t) JOIN esize s ON s.category = c.e.category JOIN epool q ON q.category = s.category AND q.idx = {draw("'word:' || c.doc_id || ':' || r || ':' || t")} % s.n
  JOIN avoid a ON a.doc_id = c.doc_id) GROUP BY ALL""", "eelig esize epool avoid")


@query("extrinsic_negatives", WRITE.replace("{p}", "eword"), "eword fine")
def extrinsic_negatives(spark, sf):
    return ops.extrinsic_negatives(annotated(spark, sf), 2)
