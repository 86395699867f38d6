"""Queries on selector agreement, metrics, tests and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from salience.functions import text as tx
from salience.functions.verdict import p_cell
from salience.operators import checks, compare, corrections, evaluate, scoring, select
from salience.plans.derive import documents, masked_sql, predictions, selections, toks_sql, words_sql
from salience.plans.registry import part, query, table
from salience.plans.stems import stems_sql
from salience.session import scratch_path
from salience.sources.reports import read_reports, write_report

PLAIN = lambda x: rf"""regexp_replace(translate({x}, '’‘“”–­', '''''""--'), '^\s+|\s+$', '', 'g')"""

part("picks3", f"""SELECT d.doc_id, text, {PLAIN("sents[a.sid + 1]")} AS s_a, {PLAIN("sents[b.sid + 1]")} AS s_b, {PLAIN("sents[c.sid + 1]")} AS s_c,
  {masked_sql('sents', 'a.sid')} AS doc_a, sents FROM docs d JOIN sel_a a USING (doc_id) JOIN sel_b b USING (doc_id) JOIN sel_c c USING (doc_id)""", "docs sel_a sel_b sel_c")
part("class3", """SELECT doc_id, CASE WHEN s_a = s_b AND s_a = s_c THEN 'all_same' WHEN s_a = s_b THEN 'c_differs' WHEN s_a = s_c THEN 'b_differs'
  WHEN s_b = s_c THEN 'a_differs' ELSE 'all_differ' END AS class,
  s_a <> s_b AND length(s_a) = length(s_b) AND left(s_a, 20) = left(s_b, 20) AS almost_ab,
  s_a <> s_c AND length(s_a) = length(s_c) AND left(s_a, 20) = left(s_c, 20) AS almost_ac,
  s_b <> s_c AND length(s_b) = length(s_c) AND left(s_b, 20) = left(s_c, 20) AS almost_bc FROM picks3""", "picks3")
part("lens", """SELECT doc_id, len(list_filter(string_split(doc_a, '.'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g') <> ''))::BIGINT AS n_sents,
  s_a <> s_b AS differs FROM picks3""", "picks3")


def _picks3(spark, sf):
    """The three selections with text split once; same partitioning for all joins."""
    docs = documents(spark, sf)
    c = select.best(scoring.rouge2(docs)).select("doc_id", F.col("sid").alias("sid_c"))
    rows = docs.join(selections(docs), "doc_id").join(c, "doc_id").withColumn("sents", tx.sentences(F.col("text")))
    s = lambda k: tx.plain_quotes(F.get("sents", F.col(f"sid_{k}").cast("int"))).alias(f"s_{k}")
    return rows.select("doc_id", s("a"), s("b"), s("c"), tx.masked(F.col("sents"), F.col("sid_a")).alias("doc_a"))


def _lengths(spark, sf):
    return _picks3(spark, sf).select("doc_id", tx.sentence_count(F.col("doc_a")).alias("n_sents"), (F.col("s_a") != F.col("s_b")).alias("differs"))


@query("two_selectors", """SELECT doc_id, CASE WHEN s_a = s_b THEN 'same' WHEN length(s_a) = length(s_b) AND left(s_a, 20) = left(s_b, 20) THEN 'almost' ELSE 'different' END AS class,
  false AS misaligned FROM picks3""", "picks3")
def two_selectors(spark, sf):
    p = predictions(spark, sf, with_text=True)
    source = lambda k: tx.plain_quotes(tx.unmask(tx.masked(F.col("sents"), F.col(f"sid_{k}")), F.col(f"summary_{k}"))).alias(f"source_{k}")
    return compare.two_way(p.select("doc_id", *[tx.plain_quotes(F.col(f"summary_{k}")).alias(f"s_{k}") for k in "ab"], source("a"), source("b")))


@query("three_selectors", "SELECT * FROM class3", "class3")
def three_selectors(spark, sf):
    return compare.three_way(_picks3(spark, sf))


SOURCE = lambda k: PLAIN(f"replace({masked_sql('sents', f'{k}.sid')}, '<mask>', sents[{k}.sid + 1])")
part("sources3", f"""SELECT d.doc_id, {SOURCE("a")} AS o_a, {SOURCE("b")} AS o_b, {SOURCE("c")} AS o_c
  FROM docs d JOIN sel_a a USING (doc_id) JOIN sel_b b USING (doc_id) JOIN sel_c c USING (doc_id)""", "docs sel_a sel_b sel_c")


def stored_selections(spark, sf, names):
    """Pairs of each selector as tables of their own; the first also has a pair for each page, the second one for each test.

    A document without a sentence, or without an id, is in no selection; a page or test without text has an empty summary.
    """
    docs = documents(spark, sf)
    picks = {"a": lambda: scoring.rouge1(docs), "b": lambda: scoring.count_pmi(docs), "c": lambda: scoring.rouge2(docs)}
    foreign = {"a": ("pages", "page_id", 1_000_000_000, "url"), "b": ("benchmark", "item_id", 2_000_000_000, "text")}
    out = []
    for name in names:
        pairs = select.masked_pairs(docs, select.best(picks[name]())).filter("sid IS NOT NULL").select("doc_id", "document", "summary")
        if name in foreign:
            source, key, first, text = foreign[name]
            pairs = pairs.unionByName(table(spark, sf, source).select((F.lit(first) + F.col(key)).alias("doc_id"), F.lit("<mask>").alias("document"), F.coalesce(text, F.lit("")).alias("summary")))
        path = scratch_path(spark, f"pairs_{name}")
        pairs.write.parquet(path)
        out.append(spark.read.parquet(path))
        checks.need_columns(out[-1], ["doc_id", "document", "summary"], f"selection {name}")
        checks.raise_on(checks.row_checks(out[-1], {"no_summary": F.col("summary").isNull(), "no_mask": ~F.contains("document", F.lit("<mask>"))}))
    return out


@query("compared_selections", """SELECT doc_id, CASE WHEN s_a = s_b THEN 'same' WHEN length(s_a) = length(s_b) AND left(s_a, 20) = left(s_b, 20) THEN 'almost' ELSE 'different' END AS class,
  o_a <> o_b AS misaligned FROM picks3 JOIN sources3 USING (doc_id)""", "picks3 sources3")
def compared_selections(spark, sf):
    return compare.compare_two(*stored_selections(spark, sf, "ab"))


@query("compared_three_selections", "SELECT c.*, o_a <> o_b OR o_a <> o_c AS misaligned FROM class3 c JOIN sources3 USING (doc_id)", "class3 sources3")
def compared_three_selections(spark, sf):
    return compare.compare_three(*stored_selections(spark, sf, "abc"))


part("seldiff", """SELECT doc_id, 'changed' AS side FROM pred WHERE summary_a <> summary_b OR sid_a <> sid_b
  UNION ALL SELECT 1000000000 + page_id, 'first' FROM pages UNION ALL SELECT 2000000000 + item_id, 'second' FROM benchmark""", "pred")


@query("selection_difference", "SELECT * FROM seldiff", "seldiff")
def selection_difference(spark, sf):
    a, b = stored_selections(spark, sf, "ab")
    return checks.table_difference(a, b, ["doc_id"], ["document", "summary"])


@query("selection_checks", """SELECT 'rows:b' AS check, abs((SELECT count(*) FROM pages) - (SELECT count(*) FROM benchmark))::BIGINT AS n
  UNION ALL SELECT 'same_pairs', count(*)::BIGINT FROM seldiff UNION ALL SELECT 'same_again', 0::BIGINT""", "seldiff")
def selection_checks(spark, sf):
    a, b = stored_selections(spark, sf, "ab")
    equal = lambda x, y, name: checks.keyed_equal(x, y, ["doc_id"], ["document", "summary"], name)
    return checks.same_size({"a": a, "b": b}).unionByName(equal(a, b, "same_pairs")).unionByName(equal(a, a.repartition(3), "same_again"))


@query("selector_agreement", " UNION ALL ".join(
    f"SELECT '{n}' AS item, count(*) FILTER (WHERE {c}) AS n, round(100.0::DOUBLE * count(*) FILTER (WHERE {c}) / greatest(count(*), 1), 6) AS pct FROM class3"
    for n, c in [("all_same", "class = 'all_same'"), ("all_differ", "class = 'all_differ'"), ("c_differs", "class = 'c_differs'"),
                 ("b_differs", "class = 'b_differs'"), ("a_differs", "class = 'a_differs'"), ("agree_ab", "class IN ('all_same', 'c_differs')"),
                 ("agree_ac", "class IN ('all_same', 'b_differs')"), ("agree_bc", "class IN ('all_same', 'a_differs')"),
                 ("almost_ab", "almost_ab"), ("almost_ac", "almost_ac"), ("almost_bc", "almost_bc")]), "class3")
def selector_agreement(spark, sf):
    return compare.agreement_report(compare.three_way(_picks3(spark, sf)))


@query("disagreement_by_length", """SELECT b.bin::BIGINT AS bin, count(l.doc_id) AS n, round(coalesce(avg(l.differs::INT::DOUBLE), 0.0::DOUBLE), 6) AS rate,
  round(100.0::DOUBLE * count(l.doc_id) / greatest((SELECT count(*) FROM lens), 1), 6) AS share
  FROM (VALUES (1, 11), (11, 21), (21, 31), (31, 41), (41, 51), (51, 71), (71, 1000)) b(bin, hi)
  LEFT JOIN lens l ON l.n_sents >= b.bin AND l.n_sents < b.hi GROUP BY b.bin""", "lens")
def disagreement_by_length(spark, sf):
    return compare.disagreement_by_length(_lengths(spark, sf))


@query("length_correlation", """SELECT round(corr(n_sents::DOUBLE, differs::INT::DOUBLE), 6) AS r, round(avg(n_sents) FILTER (WHERE NOT differs), 6) AS mean_same,
  round(avg(n_sents) FILTER (WHERE differs), 6) AS mean_different, round(avg(n_sents), 6) AS mean_all FROM lens""", "lens")
def length_correlation(spark, sf):
    return compare.length_correlation(_lengths(spark, sf))


@query("first_differences", """SELECT doc_id, s_a, s_b, s_c, class FROM picks3 JOIN class3 USING (doc_id) WHERE class <> 'all_same' ORDER BY doc_id LIMIT 10""", "picks3 class3")
def first_differences(spark, sf):
    rows = _picks3(spark, sf)
    return compare.first_differences(compare.three_way(rows), rows.select("doc_id", "s_a", "s_b", "s_c"), 10)


part("sysp", """SELECT doc_id, dataset, checkpoint, 'a' AS system, reference, summary_a AS summary FROM pred
  UNION ALL SELECT doc_id, dataset, checkpoint, 'b', reference, summary_b FROM pred""", "pred")
part("bag", f"""SELECT doc_id, system, side, 1 AS n, unnest(t) AS g FROM tl UNION ALL
  SELECT doc_id, system, side, 2, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM tl""", "tl")
part("tl", f"""SELECT doc_id, system, 'ref' AS side, {toks_sql('reference')} AS t FROM sysp UNION ALL
  SELECT doc_id, system, 'cand', {toks_sql('summary')} FROM sysp""", "sysp")
part("sizes", "SELECT doc_id, system, side, n, greatest(len(t) - n + 1, 0) AS size FROM tl, (VALUES (1), (2)) v(n)", "tl")
part("shared", """SELECT x.doc_id, x.system, x.n, sum(least(x.c, y.c))::BIGINT AS hits FROM
  (SELECT doc_id, system, n, g, count(*) AS c FROM bag WHERE side = 'cand' GROUP BY ALL) x JOIN
  (SELECT doc_id, system, n, g, count(*) AS c FROM bag WHERE side = 'ref' GROUP BY ALL) y USING (doc_id, system, n, g) GROUP BY ALL""", "bag")
part("prf", """SELECT c.doc_id, c.system, c.n, coalesce(s.hits, 0) AS hits, c.size AS nc, r.size AS nr FROM sizes c
  JOIN sizes r ON r.doc_id = c.doc_id AND r.system = c.system AND r.n = c.n AND r.side = 'ref'
  LEFT JOIN shared s ON s.doc_id = c.doc_id AND s.system = c.system AND s.n = c.n WHERE c.side = 'cand'""", "sizes shared")
part("score", """SELECT p.doc_id, dataset, checkpoint, p.system, m.metric, m.score FROM sysp p JOIN (
  SELECT doc_id, system, 'rouge' || n AS metric, CASE WHEN nc + nr > 0 THEN 2.0::DOUBLE * hits / (nc + nr) ELSE 0.0::DOUBLE END AS score FROM prf
  UNION ALL SELECT doc_id, system, 'precision' || n, CASE WHEN nc > 0 THEN hits::DOUBLE / nc ELSE 0.0::DOUBLE END FROM prf
  UNION ALL SELECT doc_id, system, 'recall' || n, CASE WHEN nr > 0 THEN hits::DOUBLE / nr ELSE 0.0::DOUBLE END FROM prf) m USING (doc_id, system)""", "sysp prf")
part("pair", """SELECT doc_id, dataset, checkpoint, metric, max(score) FILTER (WHERE system = 'a') AS a, max(score) FILTER (WHERE system = 'b') AS b
  FROM score GROUP BY doc_id, dataset, checkpoint, metric""", "score")
part("stems", stems_sql("SELECT DISTINCT unnest(t) AS w FROM tl"), "tl")
part("stp", """SELECT doc_id, system, side, p, st FROM (SELECT doc_id, system, side, unnest(t) AS w, unnest(range(len(t))) AS p FROM tl) JOIN stems USING (w)""", "tl stems")
part("stbag", """SELECT doc_id, system, side, 1 AS n, st AS g FROM stp UNION ALL SELECT doc_id, system, side, 2, st || ' ' || nx FROM (
  SELECT *, lead(st) OVER (PARTITION BY doc_id, system, side ORDER BY p) AS nx FROM stp) WHERE nx IS NOT NULL""", "stp")
part("sthits", """SELECT x.doc_id, x.system, 'n' || x.n AS kind, sum(least(x.c, y.c))::BIGINT AS hits FROM
  (SELECT doc_id, system, n, g, count(*) AS c FROM stbag WHERE side = 'cand' GROUP BY ALL) x JOIN
  (SELECT doc_id, system, n, g, count(*) AS c FROM stbag WHERE side = 'ref' GROUP BY ALL) y USING (doc_id, system, n, g) GROUP BY ALL
  UNION ALL SELECT doc_id, system, 'L', len(list_reduce(list_prepend([]::BIGINT[], places), lambda a, x:
    a[1:len(list_filter(a, lambda t: t < x[1]))] || x || a[len(list_filter(a, lambda t: t < x[1])) + 2:])) FROM (
    SELECT x.doc_id, x.system, list([x.p::BIGINT] ORDER BY y.p, x.p DESC) AS places FROM stp x ANTI JOIN stsame USING (doc_id, system) JOIN stp y
    ON y.doc_id = x.doc_id AND y.system = x.system AND y.st = x.st AND x.side = 'cand' AND y.side = 'ref' GROUP BY ALL)
  UNION ALL SELECT doc_id, system, 'L', n FROM stsame""", "stbag stp stsame")
# a text is its own longest common subsequence
part("stsame", """SELECT x.doc_id, x.system, len(x.t) AS n FROM tl x JOIN tl y USING (doc_id, system, t) WHERE x.side = 'cand' AND y.side = 'ref'""", "tl")
# summary and reference are one sentence each, so the union over sentences is one common subsequence
part("stscore", """SELECT p.doc_id, dataset, checkpoint, p.system, m.metric, CASE m.over WHEN 'f' THEN
    CASE WHEN nc + nr > 0 THEN 2.0::DOUBLE * coalesce(hits, 0) / (nc + nr) ELSE 0.0::DOUBLE END
    WHEN 'p' THEN CASE WHEN nc > 0 THEN coalesce(hits, 0)::DOUBLE / nc ELSE 0.0::DOUBLE END
    ELSE CASE WHEN nr > 0 THEN coalesce(hits, 0)::DOUBLE / nr ELSE 0.0::DOUBLE END END AS score
  FROM sysp p CROSS JOIN (VALUES ('rouge1', 1, 'n1', 'f'), ('precision1', 1, 'n1', 'p'), ('recall1', 1, 'n1', 'r'), ('rouge2', 2, 'n2', 'f'),
    ('precision2', 2, 'n2', 'p'), ('recall2', 2, 'n2', 'r'), ('rougeL', 1, 'L', 'f'), ('rougeLsum', 1, 'L', 'f')) m(metric, n, kind, over)
  JOIN (SELECT c.doc_id, c.system, c.n, c.size AS nc, r.size AS nr FROM sizes c JOIN sizes r USING (doc_id, system, n) WHERE c.side = 'cand' AND r.side = 'ref') z
    ON z.doc_id = p.doc_id AND z.system = p.system AND z.n = m.n
  LEFT JOIN sthits h ON h.doc_id = p.doc_id AND h.system = p.system AND h.kind = m.kind""", "sysp sizes sthits")
part("tt", """SELECT dataset, checkpoint, metric, n, round(m, 6) AS mean_diff, round(CASE WHEN n > 1 AND sd > 1e-12 THEN m / (sd / sqrt(n)) END, 6) AS t FROM (
  SELECT dataset, checkpoint, metric, count(*) AS n, avg(a - b) AS m, stddev_samp(a - b) AS sd FROM pair WHERE a <> 0 OR b <> 0 GROUP BY ALL)""", "pair")
# Student's two-sided p is the incomplete beta function at nu / (nu + t^2), a power series with positive terms; for small t
# the series of the complement converges faster.
part("tseries", """SELECT *, CASE WHEN abs(t) < 3 THEN
    1 - exp(0.5 * ln(y) + nu / 2 * ln(1 - y) - lbeta) / 0.5 * list_sum(list_transform(range(0, 100 + (60 * (nu + t * t) / nu + 10 * t * t)::BIGINT),
      lambda k: exp(lgamma(nu / 2 + 0.5 + k) - lgamma(nu / 2 + 0.5) - lgamma(1.5 + k) + lgamma(1.5) + k * ln(y))))
  ELSE exp(nu / 2 * ln(1 - y) + 0.5 * ln(y) - lbeta) / (nu / 2) * list_sum(list_transform(range(0, 100 + (60 / y)::BIGINT),
      lambda k: exp(lgamma(nu / 2 + 0.5 + k) - lgamma(nu / 2 + 0.5) - lgamma(nu / 2 + 1 + k) + lgamma(nu / 2 + 1) + k * ln(1 - y)))) END AS p FROM (
  SELECT *, t * t / (nu + t * t) AS y, lgamma(nu / 2) + lgamma(0.5) - lgamma(nu / 2 + 0.5) AS lbeta FROM (SELECT *, (n - 1)::DOUBLE AS nu FROM tt WHERE t <> 0))""", "tt")
part("ptests", """SELECT dataset, checkpoint, metric, n, mean_diff, t, CASE WHEN t < 0 THEN 'LOWER' WHEN t >= 0 THEN 'HIGHER' END AS direction,
  CASE WHEN t = 0 THEN 1.0::DOUBLE ELSE s.p END AS p_raw FROM tt LEFT JOIN tseries s USING (dataset, checkpoint, metric, n, mean_diff, t)""", "tt tseries")
part("tests", "SELECT dataset, checkpoint, metric, direction, p_raw FROM ptests WHERE t IS NOT NULL", "ptests")
FAMILY = """SELECT *, least(1.0::DOUBLE, max((family_size - k + 1) * p_raw) OVER (PARTITION BY {f} ORDER BY k ROWS UNBOUNDED PRECEDING)) AS p_holm,
  least(1.0::DOUBLE, min(p_raw * family_size / k) OVER (PARTITION BY {f} ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_bh
  FROM (SELECT *, {f} AS family_name, row_number() OVER (PARTITION BY {f} ORDER BY p_raw, metric, checkpoint, dataset) AS k, count(*) OVER (PARTITION BY {f}) AS family_size FROM tests)"""
part("corr_ds", FAMILY.replace("{f}", "dataset"), "tests")
part("corr_all", FAMILY.replace("{f}", "'ALL'"), "tests")


def paired(spark, sf):
    return evaluate.paired_scores(predictions(spark, sf))


def tests(spark, sf):
    """Paired t tests with Student's p-value, where t is defined."""
    t = evaluate.with_p(evaluate.paired_t(paired(spark, sf))).filter(F.col("t").isNotNull())
    return t.select("dataset", "metric", "checkpoint", "direction", "p_raw")


@query("reference_join", "SELECT doc_id, dataset, checkpoint, reference, summary_a, summary_b FROM pred", "pred")
def reference_join(spark, sf):
    return predictions(spark, sf).drop("sid_a", "sid_b")


@query("metric_scores", "SELECT doc_id, dataset, checkpoint, system, metric, round(score, 6) AS score FROM score", "score")
def metric_scores(spark, sf):
    return evaluate.long_scores(paired(spark, sf)).withColumn("score", tx.r6(F.col("score")))


@query("stemmed_metric_scores", "SELECT doc_id, dataset, checkpoint, system, metric, round(score, 6) AS score FROM stscore", "stscore")
def stemmed_metric_scores(spark, sf):
    return evaluate.long_scores(evaluate.summary_scores(predictions(spark, sf))).withColumn("score", tx.r6(F.col("score")))


@query("stemmed_subsequence_scores", """SELECT doc_id, dataset, checkpoint, metric, round(max(score) FILTER (WHERE system = 'a'), 6) AS a,
  round(max(score) FILTER (WHERE system = 'b'), 6) AS b FROM stscore WHERE metric = 'rougeL' GROUP BY ALL""", "stscore")
def stemmed_scores(spark, sf):
    return evaluate.subsequence_scores(predictions(spark, sf))


@query("line_union_scores")
def line_union_scores(spark, sf):
    p = predictions(spark, sf, with_text=True)
    both = F.concat_ws("\n", "summary_a", "summary_b")
    return p.select("doc_id", evaluate.line_union_score(both, F.array_join("sents", "\n")).alias("score"))


@query("decided_rows", "SELECT doc_id, metric, round(a, 6) AS a, round(b, 6) AS b FROM pair WHERE a <> 0 OR b <> 0", "pair")
def decided_rows(spark, sf):
    return paired(spark, sf).filter("a <> 0 OR b <> 0").select("doc_id", "metric", tx.r6(F.col("a")).alias("a"), tx.r6(F.col("b")).alias("b"))


@query("better_counts", """SELECT dataset, metric, count(*) FILTER (WHERE a > b) AS a_better, count(*) FILTER (WHERE a < b) AS b_better,
  count(*) FILTER (WHERE a = b) AS equal FROM pair GROUP BY dataset, metric""", "pair")
def better_counts(spark, sf):
    return evaluate.better_counts(paired(spark, sf))


@query("both_metrics_agree", """SELECT x.dataset, count(*) FILTER (WHERE x.a > x.b AND y.a > y.b) AS both_a, count(*) FILTER (WHERE x.a < x.b AND y.a < y.b) AS both_b
  FROM pair x JOIN pair y USING (doc_id) WHERE x.metric = 'rouge1' AND y.metric = 'rouge2' GROUP BY x.dataset""", "pair")
def both_metrics_agree(spark, sf):
    return evaluate.both_agree(paired(spark, sf), "rouge1", "rouge2")


@query("paired_t_tests", """SELECT *, CASE WHEN t < 0 THEN 'LOWER' WHEN t >= 0 THEN 'HIGHER' END AS direction FROM tt""", "tt")
def paired_t_tests(spark, sf):
    return evaluate.paired_t(paired(spark, sf))


@query("paired_t_p_values", "SELECT dataset, checkpoint, metric, n, mean_diff, t, direction, round(p_raw, 6) AS p_raw, p_raw < 0.05 AS significant FROM ptests", "ptests")
def paired_t_p_values(spark, sf):
    return evaluate.with_p(evaluate.paired_t(paired(spark, sf))).withColumn("p_raw", tx.r6(F.col("p_raw")))


@query("mean_scores", """SELECT dataset, checkpoint, system, metric, count(*) AS n, round(avg(score), 6) AS mean FROM score GROUP BY ALL""", "score")
def mean_scores(spark, sf):
    return evaluate.mean_scores(paired(spark, sf))


@query("result_matrix", "SELECT dataset, checkpoint, system, " + ", ".join(
    f"round(avg(score) FILTER (WHERE metric = '{m}'), 6) AS {m}" for m in evaluate.SUMMARY_METRICS) + " FROM stscore GROUP BY ALL", "stscore")
def result_matrix(spark, sf):
    return evaluate.result_matrix(evaluate.summary_scores(predictions(spark, sf)), evaluate.SUMMARY_METRICS)


@query("corpus_metric", """SELECT dataset, system, metric, round(mean * 100, 4) AS mean, round(mid * 100, 4) AS boot_mid, round(gen_len, 4) AS gen_len FROM
  (SELECT dataset, system, metric, avg(score) AS mean FROM stscore WHERE metric LIKE 'rouge%' GROUP BY ALL)
  JOIN (SELECT dataset, system, metric, quantile_cont(s / n, 0.5) AS mid FROM (
    SELECT dataset, system, metric, rep, sum(w * score) AS s, sum(w) AS n FROM (
      SELECT dataset, system, metric, score, k * 8 + i AS rep, CASE WHEN u < 24109 THEN 0 WHEN u < 48219 THEN 1 WHEN u < 60273 THEN 2 WHEN u < 64292 THEN 3
        WHEN u < 65296 THEN 4 WHEN u < 65497 THEN 5 WHEN u < 65531 THEN 6 ELSE 7 END AS w FROM (
        SELECT *, ('0x' || substr(h, 1 + 4 * i::INT, 4))::BIGINT AS u FROM (
          SELECT *, md5('boot:' || doc_id || ':' || k) AS h FROM stscore, range(125) r(k) WHERE metric LIKE 'rouge%'), range(8) z(i)))
    GROUP BY ALL) WHERE n > 0 GROUP BY ALL) USING (dataset, system, metric)
  JOIN (SELECT dataset, system, avg(len(regexp_extract_all(lower(summary), '[a-z0-9]+'))) AS gen_len FROM sysp GROUP BY ALL) USING (dataset, system)""", "stscore sysp")
def corpus_metric(spark, sf):
    p = predictions(spark, sf)
    size = lambda c: F.size(tx.tokens(F.col(c)))
    chosen = evaluate.summary_scores(p, keep=[size("summary_a").alias("len_a"), size("summary_b").alias("len_b")]).filter(F.col("metric").isin(evaluate.HEADLINE_METRICS))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("system"), F.col(s).alias("score"), F.col(f"len_{s}").alias("gen_len")) for s in "ab"]))
    return evaluate.corpus_metric(chosen.select("dataset", "metric", "doc_id", each.alias("x")).select("dataset", "metric", "doc_id", "x.*"), ["dataset"])


@query("widened_results", f"""SELECT p.doc_id, p.dataset, p.checkpoint, p.summary_a, round(s.score, 6) AS f1,
  array_to_string(({words_sql('p.reference')})[1:64], ' ') = p.reference AS guard_ok FROM pred p
  LEFT JOIN (SELECT doc_id, score FROM score WHERE system = 'a' AND metric = 'rouge1') s USING (doc_id)""", "pred score")
def widened_results(spark, sf):
    """Scores stored by one run with the first 64 words of the reference, added to the results of another run."""
    p = predictions(spark, sf)
    path = scratch_path(spark, "scores")
    kept = evaluate.paired_scores(p, keep=[tx.first_words(F.col("reference"), 64).alias("reference")])
    kept.filter(F.col("metric") == "rouge1").select("doc_id", tx.r6(F.col("a")).alias("f1"), "reference").write.parquet(path)
    base = p.select("doc_id", "dataset", "checkpoint", "summary_a", "reference")
    return evaluate.widen(base, spark.read.parquet(path), ["doc_id"], "reference").drop("reference")


CORR = "SELECT dataset, metric, checkpoint, direction, family_name, family_size, round(p_raw, 6) AS p_raw, round(p_holm, 6) AS p_holm, round(p_bh, 6) AS p_bh FROM "


@query("corrected_per_dataset", CORR + "corr_ds", "corr_ds")
def corrected_per_dataset(spark, sf):
    return corrections.rounded(corrections.corrected(tests(spark, sf)))


@query("corrected_global", CORR + "corr_all", "corr_all")
def corrected_global(spark, sf):
    return corrections.rounded(corrections.corrected(tests(spark, sf), []))


@query("lost_significance", """SELECT dataset, metric, checkpoint, round(p_raw, 6) AS p_raw, round(p_bh, 6) AS p_bh FROM corr_ds WHERE p_raw < 0.05 AND p_bh >= 0.05""", "corr_ds")
def lost_significance(spark, sf):
    return corrections.lost_significance(corrections.corrected(tests(spark, sf))).select(
        "dataset", "metric", "checkpoint", tx.r6(F.col("p_raw")).alias("p_raw"), tx.r6(F.col("p_bh")).alias("p_bh"))


@query("significance_tally", """SELECT CASE WHEN grouping(dataset) = 1 THEN 'TOTAL' ELSE dataset END AS dataset, CASE WHEN grouping(metric) = 1 THEN 'ALL' ELSE metric END AS metric,
  count(*) AS tests, count(*) FILTER (WHERE p_raw < 0.05 AND direction = 'HIGHER') AS raw_wins, count(*) FILTER (WHERE p_raw < 0.05 AND direction = 'LOWER') AS raw_losses,
  count(*) FILTER (WHERE p_bh < 0.05 AND direction = 'HIGHER') AS bh_wins, count(*) FILTER (WHERE p_bh < 0.05 AND direction = 'LOWER') AS bh_losses,
  count(*) FILTER (WHERE p_bh >= 0.05) AS bh_rest FROM corr_ds GROUP BY ROLLUP (dataset, metric)""", "corr_ds")
def significance_tally(spark, sf):
    return corrections.tally(corrections.corrected(tests(spark, sf)))


@query("p_value_cells", """SELECT dataset, metric, checkpoint, CASE WHEN p < 0.0001 THEN printf('%.2e', p) ELSE printf('%.4f', p) END || ' ' || CASE WHEN p < 0.05 THEN '*' ELSE ' ' END
  || CASE direction WHEN 'HIGHER' THEN '(+)' WHEN 'LOWER' THEN '(-)' ELSE '(?)' END AS cell FROM (SELECT *, p_raw AS p FROM tests)""", "tests")
def p_value_cells(spark, sf):
    return tests(spark, sf).select("dataset", "metric", "checkpoint", p_cell(F.col("p_raw"), F.col("direction")).alias("cell"))


@query("duplicate_tests", """SELECT dataset, metric, checkpoint, 2::BIGINT AS copies FROM tests, range(2) WHERE metric = 'rouge2'""", "tests")
def duplicate_tests(spark, sf):
    t = tests(spark, sf).select("dataset", "metric", "checkpoint")
    return evaluate.duplicate_tests(t.unionByName(t.filter(F.col("metric") == "rouge2")))


@query("report_text_round_trip", "SELECT dataset, metric, checkpoint, direction, round(p_raw, 6) AS p_raw FROM tests", "tests")
def report_text(spark, sf):
    path = scratch_path(spark, "reports")
    write_report(tests(spark, sf), path)
    return read_reports(spark, path).select("dataset", "metric", "checkpoint", "direction", tx.r6(F.col("p_raw")).alias("p_raw"))
