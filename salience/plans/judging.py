"""Queries on prompts, verdicts, judging runs and length-standardized rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from salience.functions import text as tx
from salience.functions import verdict as vd
from salience.operators import evaluate, judge, length
from salience.operators.scale import gathered
from salience.plans.derive import predictions, words_sql
from salience.plans.evaluation import paired
from salience.plans.registry import part, query
from salience.session import scratch_path
from salience.streaming.judging import continue_run, judge_arrivals, results_so_far

# A rate card per million tokens; the model "other" is missing from it on purpose.
RATES = [("small", 0.2, 1.2), ("large", 2.0, 12.0)]


def prices(spark):
    return spark.createDataFrame(RATES, "model STRING, input DOUBLE, output DOUBLE")


def style_of(dataset):
    return F.when(dataset == "en", "news").otherwise("procedural")


def model_of(doc_id):
    return F.when(doc_id % 3 == 0, "small").when(doc_id % 3 == 1, "large").otherwise("other")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def prompt_sql(style: str, ref: str, a: str, b: str) -> str:
    pieces = vd.TASK.split("%s")
    crit = f"CASE WHEN {style} THEN {_q(vd.CRITERIA['news'])} ELSE {_q(vd.CRITERIA['procedural'])} END"
    fill = [crit, ref, a, b]
    return " || ".join(x for pair in zip([_q(p) for p in pieces], [f"({f})" for f in fill] + [None]) for x in pair if x)


def shared_sql(x: str) -> str:
    return f"len(list_intersect(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(reference), '[a-z0-9]+'))))"


def said_sql(a: str, b: str, bonus: int = 1, margin: int = 1) -> str:
    sa, sb = shared_sql(a), shared_sql(b)
    lead = f"({sa} + {bonus} - {sb})"
    return (f"'Feedback: A shares ' || {sa} || ' words and B shares ' || {sb} || ' with the reference. [RESULT] ' || "
            f"CASE WHEN {lead} > {margin} THEN 'A' WHEN {lead} < -{margin} THEN 'B' ELSE 'TIE' END")


def raw_sql(c: str) -> str:
    tail = rf"upper(regexp_replace(list_last(string_split({c}, '[RESULT]')), '^\s+|\s+$', '', 'g'))"
    return f"CASE WHEN NOT contains({c}, '[RESULT]') THEN 'TIE_2' WHEN starts_with({tail}, 'A') THEN 'A' WHEN starts_with({tail}, 'B') THEN 'B' ELSE 'TIE' END"


def feedback_sql(c: str) -> str:
    return rf"regexp_replace(CASE WHEN contains({c}, '[RESULT]') THEN array_to_string(string_split({c}, '[RESULT]')[:-2], '') ELSE {c} END, '^\s+|\s+$', '', 'g')"


part("slotted", """SELECT *, ('0x' || substr(md5(dataset || ':' || checkpoint || ':' || doc_id), 1, 1))::BIGINT < 8 AS a_first FROM pred""", "pred")
SINGLE_PROMPT = prompt_sql("dataset = 'en'", "reference", "CASE WHEN a_first THEN summary_a ELSE summary_b END", "CASE WHEN a_first THEN summary_b ELSE summary_a END")
part("single_prompts", f"SELECT doc_id, {SINGLE_PROMPT} AS prompt FROM slotted", "slotted")
part("said", f"""SELECT *, {said_sql('sa', 'sb')} AS completion FROM (SELECT *, CASE WHEN a_first THEN summary_a ELSE summary_b END AS sa,
  CASE WHEN a_first THEN summary_b ELSE summary_a END AS sb FROM slotted)""", "slotted")
part("judged", f"""SELECT *, CASE WHEN raw_result = 'A' THEN CASE WHEN a_first THEN 'a' ELSE 'b' END WHEN raw_result = 'B' THEN CASE WHEN a_first THEN 'b' ELSE 'a' END ELSE 'tie' END AS winner
  FROM (SELECT *, {raw_sql('completion')} AS raw_result, {feedback_sql('completion')} AS feedback FROM said)""", "said")
part("dual0", f"SELECT *, {said_sql('summary_a', 'summary_b')} AS c1, {said_sql('summary_b', 'summary_a')} AS c2, {prompt_sql(chr(100) + 'ataset = ' + chr(39) + 'en' + chr(39), 'reference', 'summary_a', 'summary_b')} AS prompt FROM pred", "pred")
part("dual1", f"""SELECT *, CASE raw_a_as_A WHEN 'A' THEN 'a' WHEN 'B' THEN 'b' ELSE 'tie' END AS winner_a_as_A, CASE raw_a_as_B WHEN 'A' THEN 'b' WHEN 'B' THEN 'a' ELSE 'tie' END AS winner_a_as_B,
  2 * (length(prompt) // 4) AS input_tokens, length(c1) // 4 + length(c2) // 4 AS output_tokens
  FROM (SELECT *, {raw_sql('c1')} AS raw_a_as_A, {raw_sql('c2')} AS raw_a_as_B FROM dual0)""", "dual0")
part("dual", "SELECT *, winner_a_as_A = winner_a_as_B AS orders_agree, CASE WHEN winner_a_as_A = winner_a_as_B THEN winner_a_as_A ELSE 'tie' END AS winner FROM dual1", "dual1")
part("rates", "SELECT * FROM (VALUES ('small', 0.2::DOUBLE, 1.2::DOUBLE), ('large', 2.0::DOUBLE, 12.0::DOUBLE)) r(model, i, o)")
part("priced", """SELECT d.*, coalesce((input_tokens * i + output_tokens * o) / 1e6::DOUBLE, 0.0::DOUBLE) AS cost_usd FROM
  (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'other' END AS model FROM dual) d LEFT JOIN rates USING (model)""", "dual rates")


def single(spark, sf):
    p = predictions(spark, sf)
    return judge.one_order(p, style_of(F.col("dataset")))


def dual(spark, sf):
    return judge.both_orders(predictions(spark, sf), style_of(F.col("dataset")))


@query("judge_prompts", f"""SELECT doc_id, md5({prompt_sql("dataset = 'en'", 'reference', 'CASE WHEN a_first THEN summary_a ELSE summary_b END', 'CASE WHEN a_first THEN summary_b ELSE summary_a END')}) AS prompt FROM slotted""", "slotted")
def judge_prompts(spark, sf):
    return single(spark, sf).select("doc_id", F.md5("prompt").alias("prompt"))


@query("slot_assignment", "SELECT dataset, count(*) FILTER (WHERE a_first) AS first, count(*) AS n FROM slotted GROUP BY dataset", "slotted")
def slot_assignment(spark, sf):
    rows = predictions(spark, sf).withColumn("a_first", vd.a_in_first_slot(F.col("dataset"), F.col("checkpoint"), F.col("doc_id")))
    return rows.groupBy("dataset").agg(F.count_if("a_first").alias("first"), F.count("*").alias("n"))


@query("judgements", "SELECT dataset, checkpoint, doc_id, a_first, raw_result, winner, feedback FROM judged", "judged")
def judgements(spark, sf):
    return single(spark, sf).select("dataset", "checkpoint", "doc_id", "a_first", "raw_result", "winner", "feedback")


@query("verdict_parse", f"""SELECT conv_id, turn, {raw_sql('c')} AS raw_result, md5({feedback_sql('c')}) AS feedback FROM (
  SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN text || ' [RESULT] a better' WHEN 2 THEN text || '[RESULT]x[RESULT] B' ELSE text || ' [RESULT] none' END AS c FROM conversations)""")
def verdict_parse(spark, sf):
    from salience.plans.registry import table
    t = table(spark, sf, "conversations")
    k = F.col("turn") % 4
    c = F.when(k == 0, F.col("text")).when(k == 1, F.concat("text", F.lit(" [RESULT] a better"))).when(
        k == 2, F.concat("text", F.lit("[RESULT]x[RESULT] B"))).otherwise(F.concat("text", F.lit(" [RESULT] none")))
    return t.select("conv_id", "turn", vd.raw_result(c).alias("raw_result"), F.md5(vd.feedback(c)).alias("feedback"))


@query("external_judge", "SELECT doc_id, CASE WHEN length(prompt) % 2 = 1 THEN 'A' ELSE 'B' END AS raw_result FROM single_prompts", "single_prompts")
def external_judge(spark, sf):
    def make():
        def answer(prompts):
            return [f"Feedback: {len(p)} characters [RESULT] {'A' if len(p) % 2 else 'B'}" for p in prompts]
        return answer

    said = judge.run_judge(single(spark, sf), ["doc_id"], make)
    return gathered(said.select("doc_id", vd.raw_result(F.col("completion")).alias("raw_result")))


@query("dual_judgements", "SELECT doc_id, orders_agree, winner, winner_a_as_A, winner_a_as_B, raw_a_as_A, raw_a_as_B, input_tokens, output_tokens FROM dual", "dual")
def dual_judgements(spark, sf):
    return dual(spark, sf).select("doc_id", "orders_agree", "winner", "winner_a_as_A", "winner_a_as_B", "raw_a_as_A", "raw_a_as_B", "input_tokens", "output_tokens")


def pct_sql(n: str) -> str:
    return f"round(100.0::DOUBLE * {n} / greatest(n, 1), 6) AS {n}_pct"


COUNTS = "count(*) AS n, count(*) FILTER (WHERE winner = 'a') AS a, count(*) FILTER (WHERE winner = 'b') AS b, count(*) FILTER (WHERE winner = 'tie') AS tie"


@query("verdict_counts", f"""SELECT *, {pct_sql('a')}, {pct_sql('b')}, {pct_sql('tie')}, {pct_sql('no_tag')} FROM (
  SELECT dataset, checkpoint, {COUNTS}, count(*) FILTER (WHERE raw_result = 'TIE_2') AS no_tag FROM judged GROUP BY ALL)""", "judged")
def verdict_counts(spark, sf):
    return judge.verdict_counts(single(spark, sf), ["dataset", "checkpoint"])


@query("checkpoint_summary", f"""SELECT g.dataset, g.checkpoint, CASE WHEN c.n IS NULL THEN 'not run' ELSE 'done' END AS state, coalesce(c.n, 0) AS n, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(tie, 0) AS tie
  FROM (SELECT dataset, 'src' || i AS checkpoint FROM (VALUES ('en'), ('de'), ('fr'), ('es')) d(dataset), range(22) r(i)) g
  LEFT JOIN (SELECT dataset, checkpoint, {COUNTS} FROM judged GROUP BY ALL) c USING (dataset, checkpoint)""", "judged")
def checkpoint_summary(spark, sf):
    return judge.checkpoint_summary(single(spark, sf), [f"src{i}" for i in range(22)], ["en", "de", "fr", "es"])


def consensus_sql(keys: str) -> str:
    return f"""SELECT {keys}, total, agreed, total - agreed AS disagreed, both_tie, n AS decided,
  CASE WHEN ok THEN round(p, 6) END AS rate, CASE WHEN ok THEN round(1.96 * sqrt(p * (1 - p) / n), 6) END AS half_ci, CASE WHEN ok THEN round(1 - p, 6) END AS rate_b_system,
  CASE WHEN ok THEN round(agreed::DOUBLE / total, 6) END AS agree_share, CASE WHEN ok THEN round(px, 6) END AS rate_slot_a, CASE WHEN ok THEN round(py, 6) END AS rate_slot_b,
  nx AS n_slot_a, ny AS n_slot_b, CASE WHEN ok THEN round(px - py, 6) END AS advantage,
  CASE WHEN ok THEN round(1.96 * sqrt(px * (1 - px) / nx + py * (1 - py) / ny), 6) END AS advantage_half_ci
  FROM (SELECT *, n > 0 AND nx > 0 AND ny > 0 AS ok, aw::DOUBLE / nullif(n, 0) AS p, ax::DOUBLE / nullif(nx, 0) AS px, ay::DOUBLE / nullif(ny, 0) AS py FROM (
    SELECT {keys}, count(*) AS total, count(*) FILTER (WHERE orders_agree) AS agreed, count(*) FILTER (WHERE orders_agree AND winner = 'tie') AS both_tie,
    count(*) FILTER (WHERE winner = 'a') AS aw, count(*) FILTER (WHERE winner IN ('a', 'b')) AS n, count(*) FILTER (WHERE winner_a_as_A = 'a') AS ax,
    count(*) FILTER (WHERE winner_a_as_A IN ('a', 'b')) AS nx, count(*) FILTER (WHERE winner_a_as_B = 'a') AS ay, count(*) FILTER (WHERE winner_a_as_B IN ('a', 'b')) AS ny
    FROM dual GROUP BY ALL))"""


@query("consensus_stats", consensus_sql("dataset, checkpoint"), "dual")
def consensus_stats(spark, sf):
    return judge.consensus_stats(dual(spark, sf), ["dataset", "checkpoint"])


@query("raw_orders", f"""SELECT *, {pct_sql('a')}, {pct_sql('b')}, {pct_sql('tie')}, round(100.0::DOUBLE * a / greatest(a + b, 1), 6) AS a_of_decided FROM (
  SELECT dataset, checkpoint, slot, {COUNTS} FROM (SELECT dataset, checkpoint, 'A' AS slot, winner_a_as_A AS winner FROM dual UNION ALL SELECT dataset, checkpoint, 'B', winner_a_as_B FROM dual) GROUP BY ALL) WHERE a + b > 0""", "dual")
def raw_orders(spark, sf):
    return judge.raw_orders(dual(spark, sf))


def priced(spark, sf):
    return judge.with_cost(dual(spark, sf).withColumn("model", model_of(F.col("doc_id"))), prices(spark))


@query("call_prices", "SELECT doc_id, model, round(cost_usd, 6) AS cost_usd FROM priced", "priced")
def call_prices(spark, sf):
    return gathered(priced(spark, sf).select("doc_id", "model", tx.r6(F.col("cost_usd")).alias("cost_usd")))


@query("cost_totals", """SELECT dataset, count(*) AS pairs, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, round(sum(cost_usd), 6) AS cost_usd,
  string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM priced GROUP BY dataset""", "priced")
def cost_totals(spark, sf):
    return judge.cost_totals(priced(spark, sf), ["dataset"])


@query("cost_estimate", """SELECT dataset, 'large' AS model, pairs, input_tokens, 2 * pairs AS calls, 2 * pairs * 209 AS output_tokens, round((input_tokens * 2.0::DOUBLE + 2 * pairs * 209 * 12.0::DOUBLE) / 1e6::DOUBLE, 6) AS cost_usd
  FROM (SELECT dataset, count(*) AS pairs, sum(input_tokens)::BIGINT AS input_tokens FROM dual GROUP BY dataset)""", "dual")
def cost_estimate(spark, sf):
    return judge.estimate_cost(predictions(spark, sf), prices(spark), "large", style_of(F.col("dataset")), ["dataset"])


@query("settings_seen", "SELECT DISTINCT model, dataset FROM priced", "priced")
def settings_seen(spark, sf):
    return judge.settings_seen(predictions(spark, sf).withColumn("model", model_of(F.col("doc_id"))), ["model", "dataset"])


@query("metric_dominance", """SELECT dataset, count(*) FILTER (WHERE wa >= 4) AS a_dominates, count(*) FILTER (WHERE wb >= 4) AS b_dominates,
  count(*) FILTER (WHERE wb >= 4 AND winner = 'a') AS judge_a_metrics_b, count(*) FILTER (WHERE wa >= 4 AND winner = 'b') AS judge_b_metrics_a,
  count(*) FILTER (WHERE wa >= 4 AND winner = 'tie') AS judge_tie_metrics_a, count(*) FILTER (WHERE wb >= 4 AND winner = 'tie') AS judge_tie_metrics_b
  FROM (SELECT doc_id, dataset, count(*) FILTER (WHERE a > b) AS wa, count(*) FILTER (WHERE a < b) AS wb FROM pair GROUP BY ALL) LEFT JOIN (SELECT doc_id, winner FROM judged) USING (doc_id) GROUP BY dataset""", "pair judged")
def metric_dominance(spark, sf):
    p = predictions(spark, sf)
    return evaluate.dominance(evaluate.paired_scores(p), judge.one_order(p, style_of(F.col("dataset"))))


RESULT = "dataset STRING, checkpoint STRING, doc_id LONG, raw_result STRING, winner STRING"


def _judge(rows):
    return judge.one_order(rows).select("dataset", "checkpoint", "doc_id", "raw_result", "winner")


@query("resumed_run", "SELECT dataset, checkpoint, doc_id, raw_result, winner FROM judged", "judged")
def resumed_run(spark, sf):
    """A run broken off after a third of the documents, continued, then started again with nothing left to do."""
    path, work = scratch_path(spark, "run"), predictions(spark, sf)
    keys = ["dataset", "checkpoint", "doc_id"]
    continue_run(work.filter("doc_id % 3 = 0"), path, keys, RESULT, _judge)
    continue_run(work, path, keys, RESULT, _judge)
    continue_run(work, path, keys, RESULT, _judge)
    return results_so_far(spark, path, RESULT)


@query("pending_work", "SELECT doc_id FROM judged WHERE winner = 'tie'", "judged")
def pending_work(spark, sf):
    rows = single(spark, sf).select("doc_id", "winner")
    return judge.pending(rows.select("doc_id"), rows.filter("winner <> 'tie'"), ["doc_id"])


@query("streamed_judgements", "SELECT dataset, checkpoint, doc_id, raw_result, winner FROM judged", "judged")
def streamed_judgements(spark, sf):
    source, path, state = scratch_path(spark, "in"), scratch_path(spark, "out"), scratch_path(spark, "state")
    schema = "doc_id LONG, dataset STRING, checkpoint STRING, reference STRING, summary_a STRING, summary_b STRING"
    predictions(spark, sf).select("doc_id", "dataset", "checkpoint", "reference", "summary_a", "summary_b").write.parquet(source)
    judge_arrivals(spark, source, schema, path, state, _judge, files_per_batch=2).awaitTermination()
    return spark.read.parquet(path).select("dataset", "checkpoint", "doc_id", "raw_result", "winner")


# ---- length ------------------------------------------------------------------------------------------------------

LEAST = length.LEAST_IN_BIN
BINS = 5
#: Languages and sources taken together for length standardization, in few bins,
#: so that cells reach the threshold.
COARSE = "'all' AS dataset, 'src' || substr(checkpoint, 4)::BIGINT % 3 AS checkpoint"
part("lp", f"""SELECT {COARSE}, doc_id, winner, len({words_sql('summary_a')})::BIGINT AS words_a, len({words_sql('summary_b')})::BIGINT AS words_b,
  (len({words_sql('summary_a')}) - len({words_sql('summary_b')}))::BIGINT AS delta FROM judged""", "judged")
part("cuts", """SELECT DISTINCT dataset, d[1 + least(floor(n * k / 5.0)::BIGINT, n - 1)] AS cut FROM (SELECT dataset, list(delta ORDER BY delta) AS d, count(*) AS n FROM lp GROUP BY dataset), range(1, 5) r(k)""", "lp")
part("raw_bins", """SELECT dataset, k, coalesce(lo, -1000000000) AS lo, c, row_number() OVER (PARTITION BY dataset ORDER BY k) AS i FROM (
  SELECT l.dataset, (SELECT count(*) FROM cuts c WHERE c.dataset = l.dataset AND c.cut <= l.delta) AS k, (SELECT max(cut) FROM cuts c WHERE c.dataset = l.dataset AND c.cut <= l.delta) AS lo, count(*) AS c FROM lp l GROUP BY ALL)""", "cuts lp")
part("fold", """SELECT dataset, i, lo, c, c >= 30 AS full, 0 AS made FROM raw_bins WHERE i = 1
  UNION ALL SELECT b.dataset, b.i, CASE WHEN f.full THEN b.lo ELSE f.lo END, CASE WHEN f.full THEN b.c ELSE f.c + b.c END, CASE WHEN f.full THEN b.c ELSE f.c + b.c END >= 30, f.made + f.full::INT
  FROM fold f JOIN raw_bins b ON b.dataset = f.dataset AND b.i = f.i + 1""", "raw_bins")
part("bins", """SELECT dataset, j, CASE WHEN j = 0 THEN -1000000000 ELSE lo END AS lo, coalesce(lead(lo) OVER w - 1, 1000000000) AS hi, weight FROM (
  SELECT dataset, (row_number() OVER (PARTITION BY dataset ORDER BY i) - 1) AS j, lo, c + CASE WHEN "full" AND row_number() OVER (PARTITION BY dataset ORDER BY i DESC) = 1 THEN rest ELSE 0 END AS weight FROM (
    SELECT f.*, coalesce((SELECT c FROM fold z WHERE z.dataset = f.dataset AND NOT z.full AND z.i = (SELECT max(i) FROM fold y WHERE y.dataset = f.dataset)), 0) AS rest FROM fold f
    WHERE f.full OR (f.i = (SELECT max(i) FROM fold y WHERE y.dataset = f.dataset) AND NOT EXISTS (SELECT 1 FROM fold y WHERE y.dataset = f.dataset AND y.full))))
  WINDOW w AS (PARTITION BY dataset ORDER BY j)""", "fold")
part("rr", """SELECT dataset, checkpoint, n, ties, total, wins::DOUBLE / nullif(n, 0) AS rate, wins::DOUBLE / nullif(n, 0) * (1 - wins::DOUBLE / nullif(n, 0)) / nullif(n, 0) AS var, wa::DOUBLE / nullif(wb, 0) AS ratio FROM (
  SELECT dataset, checkpoint, count(*) FILTER (WHERE winner <> 'tie') AS n, count(*) FILTER (WHERE winner = 'tie') AS ties, count(*) AS total, count(*) FILTER (WHERE winner = 'a') AS wins, sum(words_a) AS wa, sum(words_b) AS wb FROM lp GROUP BY ALL)""", "lp")
part("std", f"""SELECT dataset, checkpoint, sum(w * p) AS rate, sum(w * w * p * (1 - p) / n) AS var FROM (
  SELECT dataset, checkpoint, n, wins::DOUBLE / n AS p, weight::DOUBLE / sum(weight) OVER (PARTITION BY dataset, checkpoint) AS w FROM (
    SELECT l.dataset, l.checkpoint, b.j, any_value(b.weight) AS weight, count(*) FILTER (WHERE winner <> 'tie') AS n, count(*) FILTER (WHERE winner = 'a') AS wins
    FROM lp l JOIN bins b ON l.dataset = b.dataset AND l.delta BETWEEN b.lo AND b.hi GROUP BY ALL) WHERE n >= {LEAST}) GROUP BY ALL""", "lp bins")
DISPLAY = "CASE WHEN delta <= -10 THEN '10+ shorter' WHEN delta <= -5 THEN '5-9 shorter' WHEN delta <= -2 THEN '2-4 shorter' WHEN delta <= 1 THEN 'within 1' WHEN delta <= 4 THEN '2-4 longer' WHEN delta <= 9 THEN '5-9 longer' ELSE '10+ longer' END"


def length_pairs(rows):
    coarse = F.concat(F.lit("src"), (F.substring("checkpoint", 4, 9).cast("long") % 3).cast("string")).alias("checkpoint")
    return rows.select(F.lit("all").alias("dataset"), coarse, tx.word_count(F.col("summary_a")).alias("words_a"), tx.word_count(F.col("summary_b")).alias("words_b"), "winner")


def hist(spark, sf):
    return length.histogram(length_pairs(single(spark, sf)))


def stepped(rates):
    return rates.withColumn("step", F.substring("checkpoint", 4, 9).cast("long"))


@query("decided_pairs", "SELECT dataset, checkpoint, doc_id, winner FROM judged WHERE winner IN ('a', 'b')", "judged")
def decided_pairs(spark, sf):
    return single(spark, sf).filter(F.col("winner").isin("a", "b")).select("dataset", "checkpoint", "doc_id", "winner")


@query("length_bins", """SELECT dataset, j, lo::BIGINT AS lo, hi::BIGINT AS hi, CASE WHEN lo = hi THEN lo::VARCHAR ELSE CASE WHEN lo = -1000000000 THEN '<=' ELSE lo::VARCHAR END || '..' || CASE WHEN hi = 1000000000 THEN '+' ELSE hi::VARCHAR END END AS label, weight::BIGINT AS weight FROM bins""", "bins", recursive=True)
def length_bins(spark, sf):
    return length.quantile_bins(hist(spark, sf), BINS)


@query("raw_win_rates", "SELECT dataset, checkpoint, n, ties, total, round(rate, 6) AS rate, round(var, 6) AS var, round(ratio, 6) AS ratio FROM rr", "rr")
def raw_win_rates(spark, sf):
    r = length.raw_rates(hist(spark, sf))
    return r.select("dataset", "checkpoint", "n", "ties", "total", *[tx.r6(F.col(c)).alias(c) for c in ("rate", "var", "ratio")])


@query("standardized_win_rates", "SELECT dataset, checkpoint, round(rate, 6) AS rate, round(var, 6) AS var FROM std", "std", recursive=True)
def standardized_win_rates(spark, sf):
    h = hist(spark, sf)
    s = length.standardized_rates(h, length.quantile_bins(h, BINS), LEAST)
    return s.select("dataset", "checkpoint", tx.r6(F.col("rate")).alias("rate"), tx.r6(F.col("var")).alias("var"))


@query("length_bias", f"""SELECT dataset, {DISPLAY} AS bin, count(*) AS n, round(avg((winner = 'a')::INT), 6) AS rate FROM lp WHERE winner <> 'tie' GROUP BY ALL""", "lp")
def length_bias(spark, sf):
    return length.length_bias(hist(spark, sf))


@query("length_mix", "SELECT dataset, checkpoint, count(*) AS n, " + ", ".join(
    f"round(100.0::DOUBLE * count(*) FILTER (WHERE {DISPLAY} = '{b}') / count(*), 6) AS bin_{i}" for i, b in enumerate(length.DISPLAY_NAMES)) + " FROM lp WHERE winner <> 'tie' GROUP BY dataset, checkpoint", "lp")
def length_mix(spark, sf):
    return length.length_mix(hist(spark, sf))


def _std(spark, sf):
    h = hist(spark, sf)
    return length.standardized_rates(h, length.quantile_bins(h, BINS), LEAST)


@query("first_to_last", """SELECT dataset, round((r2 - r1) * 100, 6) AS change, round(1.96 * sqrt(v1 + v2) * 100, 6) AS half_ci, abs((r2 - r1) * 100) > 1.96 * sqrt(v1 + v2) * 100 AS significant FROM (
  SELECT dataset, count(*) AS n, arg_min(rate, s) AS r1, arg_max(rate, s) AS r2, arg_min(var, s) AS v1, arg_max(var, s) AS v2 FROM (SELECT *, substr(checkpoint, 4)::BIGINT AS s FROM std) GROUP BY dataset) WHERE n >= 2""", "std", recursive=True)
def first_to_last(spark, sf):
    return length.first_to_last(stepped(_std(spark, sf)))


@query("rate_trend", """SELECT dataset, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(2.447 * se, 6) AS half_ci, abs(slope) > 2.447 * se AS significant FROM (
  SELECT *, sqrt(greatest(syy - sxy * sxy / sxx, 0) / (n - 2) / sxx) AS se FROM (SELECT dataset, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy
  FROM (SELECT dataset, rate * 100 AS y, substr(checkpoint, 4)::DOUBLE AS x FROM std) GROUP BY dataset)) WHERE n >= 3""", "std", recursive=True)
def rate_trend(spark, sf):
    return length.trend(stepped(_std(spark, sf)))


@query("residual_check", """SELECT dataset, count(*) AS n, round(coalesce(nullif(corr(ratio, r.rate), 'nan'::DOUBLE), 0), 6) AS raw_r, round(coalesce(nullif(corr(ratio, s.rate), 'nan'::DOUBLE), 0), 6) AS std_r FROM rr r JOIN std s USING (dataset, checkpoint) GROUP BY dataset HAVING count(*) >= 3""", "rr std", recursive=True)
def residual_check(spark, sf):
    h = hist(spark, sf)
    return length.residual_check(length.raw_rates(h), length.standardized_rates(h, length.quantile_bins(h, BINS), LEAST))


@query("judge_agreement", f"""SELECT dataset, count(*) AS n, round(nullif(corr(r.rate, d.rate), 'nan'::DOUBLE), 6) AS r FROM (SELECT dataset, checkpoint, rate FROM rr WHERE rate IS NOT NULL) r JOIN (
  SELECT dataset, checkpoint, avg((winner = 'a')::INT::DOUBLE) AS rate FROM (SELECT {COARSE}, winner FROM dual) WHERE winner <> 'tie' GROUP BY ALL) d USING (dataset, checkpoint) GROUP BY dataset HAVING count(*) >= 3""", "rr dual")
def judge_agreement(spark, sf):
    known = lambda rows: length.raw_rates(length.histogram(length_pairs(rows))).filter("rate IS NOT NULL")
    return length.judge_agreement(known(single(spark, sf)), known(dual(spark, sf)))
