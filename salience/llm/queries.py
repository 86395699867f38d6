"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salience.llm import counts, decontamination, jaccard, lines, mixing, neighbours, packing, pii, pivots, quality, repair, scoring, trie
from salience.plans.registry import table

QUERIES = {}
CHECK_SQL = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            CHECK_SQL[name] = sql
        return fn

    return register


def crc32_sql(x: str) -> str:
    """The unsigned crc32 of a text of ASCII signs."""
    signs = f"list_transform(range(1, length({x}) + 1), lambda i: ascii({x}[i])::BIGINT)"
    bit = "lambda v, b: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {signs}), lambda a, s: "
            f"list_reduce(list_prepend(xor(a, s), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), {bit})), 4294967295::BIGINT)")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


@query("op1_pii")
def op1_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf, "documents"))
    place = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in pii.BASE],
        F.sha2(F.array_join(F.transform(base, place), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", place), ",").alias("spans"))


@query("op3_token_counts")
def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counts.token_counts(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_quality")
def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit(docs, labels.filter(~held_out(F.col("doc_id"), 4, 2)))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op4_neighbours")
def op4_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    found = neighbours.nearest(table(spark, sf, "embeddings"), F.col("id") % 20 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


TOP_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v::DOUBLE[], d.v::DOUBLE[])::BIGINT AS score
  FROM whole q JOIN whole d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query("op9_pivots", TOP_SQL)
def op9_pivots(spark: SparkSession, sf: str) -> DataFrame:
    found = pivots.search(table(spark, sf, "embeddings"), F.col("id") % 20 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM per_source),
levels AS (
  SELECT *, 3 * source_size / weight AS ratio,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0))::DOUBLE
      / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM weighed
  WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
aims AS (
  SELECT source, source_size,
    least((3 * source_size)::DOUBLE, (SELECT max(level) FROM levels WHERE level <= ratio) * weight) AS target,
    ('0x' || md5('mix:' || coalesce('s' || source, 'n'))[1:12])::BIGINT / 281474976710656.0 AS shift
  FROM levels),
ranked AS (
  SELECT s.*, a.source_size, a.target, a.shift,
    CASE WHEN a.source_size > 0 THEN a.target / a.source_size ELSE 1.0 END AS copies,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) AS rank
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
  (size * least(floor(copies * rank + shift) - floor(copies * (rank - 1) + shift), ceil(copies)))::BIGINT AS taken
FROM ranked
"""


@query("op6_mixing", MIX_SQL)
def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    rows = mixing.mix(mixing.sized(table(spark, sf, "documents")))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


@query("op10_packing")
def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_jaccard")
def op2_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.link(table(spark, sf, "documents"), words=4, num=85, den=100)


@query("op7_lines")
def op7_lines(spark: SparkSession, sf: str) -> DataFrame:
    report = lines.line_report(table(spark, sf, "documents"), short=True)
    return report.select(
        F.nullif("id", F.lit(lines.NULL_ID)).alias("doc_id"), "n_lines", F.size("removed").cast("long").alias("n_removed"),
        F.array_join("removed", ",").alias("removed"))


@query("op8_scoring")
def op8_scoring(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scored = scoring.score(docs, ~held_out(F.col("doc_id"), 5, 1))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


CONTAMINATION_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
tests AS (
  SELECT item_id, w, least(len(w), 10) AS m FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS p FROM tests)),
places AS (
  SELECT r, m, p, array_to_string(w[p:p + m - 1], ' ') AS win
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM docs JOIN (SELECT DISTINCT m FROM tests) ON len(w) >= m)),
found AS (SELECT r, p, m, item_id FROM places JOIN windows USING (m, win)),
words AS (SELECT r, count(DISTINCT x)::BIGINT AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + m)) AS x FROM found) GROUP BY r),
items AS (
  SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, coalesce(item_id::VARCHAR, '') AS item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


@query("op13_decontamination", CONTAMINATION_SQL)
def op13_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontamination.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


REPAIR_SQL = r"""
WITH RECURSIVE rows AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS how FROM (
    SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
    CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM rows),
placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged),
judged AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed)),
filling AS (
  SELECT * FROM (VALUES ('E', 'E', 0, '', []::VARCHAR[]), ('E', 'U', 3, 'I', ['user:']), ('E', 'A', 6, 'II', ['user:', 'assistant:']),
    ('S', 'S', 0, '', []), ('S', 'U', 3, 'I', ['user:']), ('S', 'A', 6, 'II', ['user:', 'assistant:']),
    ('U', 'U', 0, '', []), ('U', 'A', 3, 'I', ['assistant:']), ('A', 'A', 0, '', []), ('A', 'U', 3, 'I', ['user:'])) t(q, r, cost, letters, lines)),
paths AS (
  SELECT conv_id, 0::BIGINT AS i, 'E' AS q, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS best
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, q, min({{'cost': cost, 'audit': audit, 'lines': lines}}) AS best FROM (
    SELECT p.conv_id, p.i + 1 AS i, e.q, p.best.cost + f.cost + e.cost AS cost, p.best.audit || f.letters || e.letter AS audit,
      p.best.lines || f.lines || e.lines AS lines
    FROM paths p JOIN filling f ON f.q = p.q JOIN judged j ON j.conv_id = p.conv_id AND j.i = p.i + 1,
      LATERAL (
        SELECT f.r AS q, 4 AS cost, 'D' AS letter, []::VARCHAR[] AS lines
        UNION ALL
        SELECT CASE left(j.role, 1) WHEN 's' THEN 'S' WHEN 'u' THEN 'U' ELSE 'A' END, CASE j.fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', [j.role || ':' || j.text]
        WHERE j.fault IN ('', 'truncated') AND f.r || left(j.role, 1) IN ('Es', 'Eu', 'Su', 'Au', 'Ua')
        UNION ALL
        SELECT CASE f.r WHEN 'U' THEN 'A' ELSE 'U' END, CASE j.fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R', [CASE f.r WHEN 'U' THEN 'assistant:' ELSE 'user:' END || j.text]
        WHERE j.fault IN ('', 'truncated')) e)
  GROUP BY conv_id, i, q),
ends AS (
  SELECT conv_id, min({{'cost': p.best.cost + f.cost, 'audit': p.best.audit || f.letters, 'lines': p.best.lines || f.lines}}) AS best
  FROM paths p JOIN filling f USING (q)
  WHERE f.r IN ('E', 'A') AND p.i = (SELECT count(*) FROM judged j WHERE j.conv_id = p.conv_id) GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit,
  sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM ends LEFT JOIN counts USING (conv_id)
""".format(crc=crc32_sql("k"))


@query("op12_repair", REPAIR_SQL)
def op12_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair.digests(repair.damage(table(spark, sf, "conversations")))


TRIE_SQL = r"""
WITH ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS k FROM conversations WHERE conv_id IS NOT NULL),
skips AS (SELECT conv_id, ({crc} % 6)::BIGINT AS h FROM ids),
turns AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, md5(text)) AS x
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, coalesce(b.x[1:h], []) || o.x[h + 1:] AS x
  FROM turns o JOIN skips USING (conv_id) LEFT JOIN turns b ON b.conv_id = o.conv_id - o.conv_id % 100),
keyed AS (SELECT conv_id, x, list_transform(x, lambda t: md5(t.role || chr(31) || md5(t.text))) AS d FROM rebuilt),
members AS (
  SELECT conv_id, depth, md5(array_to_string(d[1:depth], ',')) AS node, CASE WHEN depth > 0 THEN md5(array_to_string(d[1:depth - 1], ',')) END AS parent,
    CASE WHEN depth > 0 THEN length(x[depth].text) ELSE 0 END AS chars, depth = len(x) AS ends
  FROM (SELECT *, unnest(range(0, len(x) + 1)) AS depth FROM keyed)),
nodes AS (
  SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
lineage AS (
  SELECT a.node, n.node AS below FROM nodes n JOIN members m ON m.conv_id = n.conv_id AND m.depth = n.depth
  JOIN members a ON a.conv_id = m.conv_id AND a.depth <= m.depth),
sums AS (
  SELECT l.node, count(*) FILTER (c.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars)::BIGINT AS saved_tokens
  FROM lineage l JOIN nodes n ON n.node = l.below LEFT JOIN children c ON c.node = l.below GROUP BY l.node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN children USING (node) LEFT JOIN nodes p ON p.node = n.parent
""".format(crc=crc32_sql("k"))


@query("op11_trie", TRIE_SQL)
def op11_trie(spark: SparkSession, sf: str) -> DataFrame:
    nodes = trie.prefix_trie(table(spark, sf, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")
