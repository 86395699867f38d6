"""Queries on sources, splits, projections, checks and text expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from salience.functions import text as tx
from salience.operators import checks, select
from salience.operators.sentences import sentence_rows
from salience.plans.derive import documents, masked_sql, predictions, sents_sql, words_sql
from salience.plans.registry import part, query, table
from salience.schemas import DOCUMENT
from salience.session import scratch_path
from salience.sources import tables as src

SPLIT = "CASE WHEN substr(md5(doc_id::VARCHAR), 1, 1) < 'd' THEN 'train' WHEN substr(md5(doc_id::VARCHAR), 1, 1) < 'f' THEN 'validation' ELSE 'test' END"


def split_name(doc_id):
    d = F.substring(F.md5(doc_id.cast("string")), 1, 1)
    return F.when(d < "d", "train").when(d < "f", "validation").otherwise("test")


@query("scan_corpus", "SELECT doc_id, lang, text FROM documents")
def scan_corpus(spark, sf):
    return src.read_corpus(spark, f"{sf}/documents.parquet", DOCUMENT).select("doc_id", "lang", "text")


@query("scan_dataset", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def scan_dataset(spark, sf):
    return documents(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("split_select", f"SELECT doc_id, {SPLIT} AS split FROM documents WHERE {SPLIT} <> 'validation'")
def split_select(spark, sf):
    split = documents(spark, sf).select("doc_id", split_name(F.col("doc_id")).alias("split"))
    return src.drop_split(split, "validation")


@query("split_sink_round_trip", f"SELECT doc_id, text, {SPLIT} AS split FROM documents WHERE {SPLIT} = 'test'")
def split_sink(spark, sf):
    path = scratch_path(spark, "splits")
    src.write_splits(documents(spark, sf).select("doc_id", "text", split_name(F.col("doc_id")).alias("split")), path)
    return src.read_split(spark, path, "test").select("doc_id", "text", "split")


@query("merged_parts", "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def merged_parts(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text", "lang")
    even, odd = scratch_path(spark, "part"), scratch_path(spark, "part")
    docs.filter("doc_id % 2 = 0").write.parquet(even)
    docs.filter("doc_id % 2 <> 0").write.parquet(odd)
    return src.merge_parts(spark, [even, odd]).groupBy("lang").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("record_lines_round_trip", "SELECT doc_id, source, text FROM documents")
def record_lines(spark, sf):
    path = scratch_path(spark, "records")
    src.write_records(documents(spark, sf).select("doc_id", "source", "text"), path)
    return src.read_record_lines(spark, path, "doc_id LONG, source STRING, text STRING")


@query("record_array_source", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def record_array(spark, sf):
    # one array of at most 1000 records per line, so the file can still be split
    path = scratch_path(spark, "arrays")
    recs = documents(spark, sf).select(F.floor(F.col("doc_id") / 1000).alias("k"), F.to_json(F.struct("doc_id", "source")).alias("j"))
    arrays = recs.groupBy("k").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value"))
    arrays.select("value").write.text(path)
    return src.read_record_array(spark, path, "doc_id LONG, source STRING", one_per_line=True).groupBy("source").agg(F.count("*").alias("n"))


@query("metric_table_round_trip", "SELECT doc_id, sid, score FROM sel_a", "sel_a")
def metric_csv(spark, sf):
    from salience.operators import scoring
    path = scratch_path(spark, "csv")
    src.write_table_text(select.best(scoring.rouge1(documents(spark, sf))), path)
    return src.read_table_text(spark, path, "doc_id LONG, sid LONG, score DOUBLE")


@query("line_aligned_predictions", "SELECT doc_id, trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) AS prediction FROM documents")
def line_aligned(spark, sf):
    path = scratch_path(spark, "lines")
    docs = documents(spark, sf)
    src.write_lines(docs, path, "doc_id", "text")
    from salience.operators.scale import rank_by_number
    rows = rank_by_number(docs.select("doc_id"), "doc_id", "idx")
    return src.align_lines(rows, src.read_lines(spark, path), "idx", "prediction").select("doc_id", F.trim("prediction").alias("prediction"))


@query("canonical_columns", "SELECT doc_id, text AS document, source AS summary FROM documents")
def canonical_columns(spark, sf):
    raw = documents(spark, sf).select("doc_id", F.col("text").alias("article"), F.col("source").alias("highlights"))
    return src.canonical(raw)


@query("position_slice", "SELECT doc_id, idx FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents) WHERE idx >= 100 AND idx < 5000")
def position_slice(spark, sf):
    return select.position_slice(documents(spark, sf).select("doc_id"), "doc_id", 100, 5000)


@query("first_documents", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 200")
def first_documents(spark, sf):
    return select.first_rows(documents(spark, sf).select("doc_id", "n_chars"), "doc_id", 200)


@query("flattened_lines", r"SELECT doc_id, trim(regexp_replace(text, '[\r\n]+', ' ', 'g')) AS line FROM documents")
def flattened_lines(spark, sf):
    return documents(spark, sf).select("doc_id", tx.flatten_lines(F.col("text")).alias("line"))


@query("rejected_empty", r"SELECT 'empty_text' AS check, count(*) FILTER (WHERE trim(text) = '') AS n FROM documents UNION ALL SELECT 'empty_turn', count(*) FILTER (WHERE regexp_replace(text, '\s+', '', 'g') = '') FROM conversations")
def rejected_empty(spark, sf):
    a = checks.row_checks(documents(spark, sf), {"empty_text": tx.strip(F.col("text")) == ""})
    b = checks.row_checks(table(spark, sf, "conversations"), {"empty_turn": tx.strip(F.col("text")) == ""})
    return a.unionByName(b)


@query("selected_datasets", "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND source IN ('src1', 'src3')")
def selected_datasets(spark, sf):
    langs = checks.chosen(["en", "de", "en"], ["en", "de", "fr", "es"])
    sources = checks.chosen(["1", "src3"], [f"src{i}" for i in range(20)], {str(i): f"src{i}" for i in range(20)})
    return documents(spark, sf).select("doc_id", "lang", "source").filter(F.col("lang").isin(langs) & F.col("source").isin(sources))


@query("validation_report", f"""SELECT 'rows:b' AS check, abs((SELECT count(*) FROM sel_b) - (SELECT count(*) FROM sel_a))::BIGINT AS n
  UNION ALL SELECT 'same_reference', count(*)::BIGINT FROM pred WHERE replace({masked_sql('sents', 'sid_a')}, '<mask>', summary_a) <> replace({masked_sql('sents', 'sid_b')}, '<mask>', summary_b)
  UNION ALL SELECT 'same_choice', count(*)::BIGINT FROM pred WHERE sid_a = sid_b""", "pred sel_a sel_b")
def validation_report(spark, sf):
    p = predictions(spark, sf, with_text=True)
    restored = lambda k: tx.unmask(tx.masked(F.col("sents"), F.col(f"sid_{k}")), F.col(f"summary_{k}"))
    rows = p.select("doc_id", "sid_a", "sid_b", restored("a").alias("ra"), restored("b").alias("rb"))
    sizes = checks.same_size({"a": rows.filter("sid_a IS NOT NULL"), "b": rows.filter("sid_b IS NOT NULL")})
    return sizes.unionByName(checks.row_checks(rows, {
        "same_reference": F.col("ra") != F.col("rb"), "same_choice": F.col("sid_a") == F.col("sid_b")}))


@query("sentences", "SELECT doc_id, sid, sent FROM sent", "sent")
def sentences(spark, sf):
    return sentence_rows(documents(spark, sf))


@query("sentence_bodies", r"""SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> ''))::BIGINT AS bodies,
  len(list_filter(string_split(text, '.'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g') <> ''))::BIGINT AS stops FROM documents""")
def sentence_bodies(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.size(tx.sentence_bodies(F.col("text"))).cast("long").alias("bodies"), tx.sentence_count(F.col("text")).alias("stops"))


def _loo(spark, sf):
    d = documents(spark, sf).select("doc_id", tx.sentences(F.col("text")).alias("sents"), "text")
    return d


@query("other_sentences", """SELECT d.doc_id, s.sid, md5(array_to_string(list_filter(sents, lambda x, i: i - 1 <> s.sid), ' ')) AS context
  FROM docs d JOIN sent s USING (doc_id)""", "docs sent")
def other_sentences(spark, sf):
    d = _loo(spark, sf)
    rows = d.select("doc_id", "sents", F.explode(F.sequence(F.lit(0), F.size("sents") - 1)).alias("sid")).filter(F.size("sents") > 0)
    return rows.select("doc_id", F.col("sid").cast("long").alias("sid"), F.md5(tx.other_sentences(F.col("sents"), F.col("sid"))).alias("context"))


@query("cut_contexts", """SELECT doc_id, sid, md5(CASE WHEN p > 0 THEN substr(text, 1, p - 1) || substr(text, p + length(sent)) ELSE text END) AS context
  FROM (SELECT s.doc_id, s.sid, s.sent, d.text, instr(d.text, s.sent) AS p FROM docs d JOIN sent s USING (doc_id))""", "docs sent")
def cut_contexts(spark, sf):
    d = _loo(spark, sf).select("doc_id", "text", F.posexplode("sents").alias("sid", "sent"))
    return d.select("doc_id", F.col("sid").cast("long").alias("sid"), F.md5(tx.cut_first(F.col("text"), F.col("sent"))).alias("context"))


@query("masked_documents", f"SELECT s.doc_id, s.sid, md5({masked_sql('sents', 's.sid')}) AS masked FROM docs d JOIN sent s USING (doc_id)", "docs sent")
def masked_documents(spark, sf):
    rows = _loo(spark, sf).select("doc_id", "sents", F.posexplode("sents").alias("sid", "sent"))
    return rows.select("doc_id", F.col("sid").cast("long").alias("sid"), F.md5(tx.masked(F.col("sents"), F.col("sid"))).alias("masked"))


@query("restored_sources", f"SELECT doc_id, md5(replace({masked_sql('sents', 'sid_a')}, '<mask>', summary_a)) AS restored FROM pred", "pred")
def restored_sources(spark, sf):
    from salience.operators import scoring
    docs = documents(spark, sf)
    pairs = select.masked_pairs(docs, select.best(scoring.rouge1(docs))).filter("sid IS NOT NULL")
    return pairs.select("doc_id", F.md5(tx.unmask(F.col("document"), F.col("summary"))).alias("restored"))


@query("inserted_mask", """SELECT doc_id, md5(array_to_string(list_concat(list_concat(sents[:least(3, len(sents))], ['<mask>']), sents[least(3, len(sents)) + 1:]), ' ')) AS masked FROM docs""", "docs")
def inserted_mask(spark, sf):
    return _loo(spark, sf).select("doc_id", F.md5(tx.with_mask_sentence(F.col("sents"), 3)).alias("masked"))


@query("plain_quotes", r"""SELECT doc_id, md5(regexp_replace(translate(text, '’‘“”–­', '''''""--'), '^\s+|\s+$', '', 'g')) AS plain, length(text) AS n FROM documents""")
def plain_quotes(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(tx.plain_quotes(F.col("text"))).alias("plain"), F.length("text").cast("long").alias("n"))


@query("metric_tokens", """SELECT doc_id, count(*) AS n, count(DISTINCT w) AS kinds, md5(string_agg(w, ' ' ORDER BY sid, p)) AS digest
  FROM (SELECT doc_id, sid, unnest(t) AS w, unnest(range(len(t))) AS p FROM (SELECT doc_id, sid, regexp_extract_all(lower(sent), '[a-z0-9]+') AS t FROM sent)) GROUP BY doc_id""", "sent")
def metric_tokens(spark, sf):
    t = documents(spark, sf).select("doc_id", tx.tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("kinds"),
                    F.md5(F.array_join("t", " ")).alias("digest"))


@query("word_counts", f"""SELECT doc_id, len({words_sql('summary_a')})::BIGINT AS words_a, len({words_sql('summary_b')})::BIGINT AS words_b,
  (len({words_sql('summary_a')}) - len({words_sql('summary_b')}))::BIGINT AS delta FROM pred""", "pred")
def word_counts(spark, sf):
    p = predictions(spark, sf)
    return p.select("doc_id", tx.word_count(F.col("summary_a")).alias("words_a"), tx.word_count(F.col("summary_b")).alias("words_b")).withColumn(
        "delta", F.col("words_a") - F.col("words_b"))


@query("truncated_texts", f"""SELECT doc_id, array_to_string({words_sql('text')}[:64], ' ') AS short, (length(text) // 4)::BIGINT AS estimate FROM documents""")
def truncated_texts(spark, sf):
    return documents(spark, sf).select("doc_id", tx.first_words(F.col("text"), 64).alias("short"), tx.token_estimate(F.col("text")).alias("estimate"))


@query("one_sentence_per_line", "SELECT doc_id, array_to_string(sents, chr(10)) AS lines FROM docs", "docs")
def one_per_line(spark, sf):
    return documents(spark, sf).select("doc_id", tx.one_per_line(F.col("text")).alias("lines"))


@query("percentages", "SELECT lang, 100.0::DOUBLE * count(*) FILTER (WHERE n_chars > 1000) / greatest(count(*), 1) AS pct FROM documents GROUP BY lang")
def percentages(spark, sf):
    return documents(spark, sf).groupBy("lang").agg(tx.percent(F.count_if(F.col("n_chars") > 1000), F.count("*")).alias("pct"))
