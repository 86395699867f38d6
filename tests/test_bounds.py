"""Work on batches is cut by tokens or bytes; long steps take the cheap way."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from salience.functions import documents as dc
from salience.functions import entities as en
from salience.functions import matching as mt
from salience.functions import text as tx
from salience.operators import compare, evaluate, scoring, vectors

LISTS = pa.array([[["a", "b"], [], ["a"]], None, [["c"] * 5], [], [["b", "a"], ["a"]]], pa.list_(pa.list_(pa.string())))


def plan(df):
    return df._jdf.queryExecution().toString()


def test_token_cuts():
    parts = list(dc.token_cuts(LISTS, 4))
    assert [len(p) for p in parts] == [2, 1, 2]
    assert pa.concat_arrays([dc.Tokens(p).scored(dc.shared_words(dc.Tokens(p))) for p in parts]).to_pylist() == dc.Tokens(LISTS).scored(dc.shared_words(dc.Tokens(LISTS))).to_pylist()
    assert [len(p) for p in dc.token_cuts(LISTS.slice(2, 3), 4)] == [1, 2]
    assert list(dc.token_cuts(LISTS.slice(0, 0))) == []


def test_pmi_gathers_no_lists(spark):
    docs = spark.createDataFrame([(1, "the cat sat. the dog. ... rare words here"), (2, "the cat"), (None, "b a. a c."), (3, None)], "doc_id LONG, text STRING")
    scores = scoring.overlap_and_pmi(docs)
    assert "collect_list" not in plan(scores)
    got = {(r.doc_id, r.sid): (r.rouge1, r.pmi) for r in scores.collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (None, 0), (None, 1)}
    # words as frequent as this corpus makes them, or none of them frequent: the same scores
    rare = {(r.doc_id, r.sid): (r.rouge1, r.pmi) for r in scoring.overlap_and_pmi(docs, scoring.corpus_counts(docs)).collect()}
    old, scoring.HEAVY_WORDS = scoring.HEAVY_WORDS, 0
    try:
        none = {(r.doc_id, r.sid): (r.rouge1, r.pmi) for r in scoring.overlap_and_pmi(docs).collect()}
    finally:
        scoring.HEAVY_WORDS = old
    for key, (rouge, pmi) in got.items():
        assert rare[key] == (rouge, pmi)
        assert none[key] == (rouge, pytest.approx(pmi, abs=2e-6))


def test_pmi_lists_only_words_that_sentences_share():
    t = dc.Tokens(pa.array([[["x", "a", "a"], ["x", "b"], []], [["b", "c", "c"]], None], pa.list_(pa.list_(pa.string()))))
    bits = lambda known, whole, mu=64.0: dc.known_bits(t, pa.array(known, pa.string()), np.full(len(known), 2.0), 9.0, mu, whole).to_pylist()
    listed = lambda found: [[[(w["w"], w["c"], w["c_doc"]) for w in s["rare"]] for s in doc] for doc in found]
    found = bits([], True)
    assert listed(found) == [[[("x", 1, 2)], [("x", 1, 2)], []], [[]], []]
    assert [s["far_bits"] for s in found[0]] == pytest.approx([2 * np.log2(64 / 66), np.log2(64 / 67), 0.0])
    # the same bits as with the word's count in the corpus, whatever that is
    p0 = 3.0 / 9.0
    assert found[0][1]["far_bits"] == pytest.approx(np.log2(64 * p0 / (3 + 64) / p0))
    assert bits(["a", "b"], False)[0][0]["near_bits"] == pytest.approx(found[0][0]["far_bits"])
    # a vocabulary from elsewhere may lack a word, so all are looked up; without smoothing lone words have no bits
    assert [sorted(w for w, _, _ in s) for doc in listed(bits([], False)) for s in doc] == [["a", "x"], ["b", "x"], [], ["b", "c"]]
    assert {s["far_bits"] for doc in bits([], False) + bits([], True, 0.0) for s in doc} == {0.0}


def test_pmi_sentences_meet_no_words(spark):
    docs = spark.createDataFrame([(1, "the cat sat. the dog. ... rare words here"), (2, "the cat. rare words"), (2, "the cat. rare words")], "doc_id LONG, text STRING")
    text = plan(scoring.overlap_and_pmi(docs))
    assert "hashpartitioning(doc_id" in text or "RepartitionByExpression [doc_id" in text
    assert "xxhash64" not in text and "ArrowEvalPython" not in text  # no made-up keys for sentences; scored once, into a table
    got = {(r.doc_id, r.sid): r.pmi for r in scoring.overlap_and_pmi(docs).collect()}
    # a vocabulary without some words: those add nothing
    some = scoring.corpus_counts(docs).filter("w <> 'rare'")
    less = {(r.doc_id, r.sid): r.pmi for r in scoring.overlap_and_pmi(docs, some).collect()}
    assert set(less) == set(got) and got[1, 3] != less[1, 3]


def test_restored_texts_are_compared_by_digest(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "doc_id LONG, document STRING, summary STRING")
    a = make((1, "x " * 500 + "<mask>", "s."), (2, "<mask> b.", "a."), (3, None, "a."), (4, "<mask>", "“q”"))
    b = make((1, "x " * 500 + "<mask>", "s."), (2, "<mask> c.", "a."), (3, "<mask>", "a."), (4, "<mask>", '"q"'))
    assert max(len(r.source_a or "") for r in compare._plain(a, "a").collect()) == 64
    assert {r.doc_id: (r["class"], r.misaligned) for r in compare.compare_two(a, b).collect()} == {
        1: ("same", False), 2: ("same", True), 3: ("same", None), 4: ("same", False)}
    assert {r.doc_id: r.misaligned for r in compare.compare_three(a, a, b).collect()} == {1: False, 2: True, 3: None, 4: False}


def test_rest_lengths_in_blocks(monkeypatch):
    r = random.Random(3)
    docs = [[[f"w{r.randrange(r.choice([3, 30]))}" for _ in range(r.choice([0, 1, 7, 63, 64, 65, 130]))] for _ in range(r.randrange(7))] for _ in range(60)]
    column = pa.array(docs, pa.list_(pa.list_(pa.string())))
    want = [mt.lcs_length(s, [t for j, x in enumerate(doc) if j != i for t in x]) for doc in docs for i, s in enumerate(doc)]
    for hits in (1, 200, 1 << 21):
        monkeypatch.setattr(mt, "CUT_HITS", hits)
        assert np.concatenate([mt.rest_lengths(dc.Tokens(p)) for p in dc.token_cuts(column, 500)]).tolist() == want
    assert mt.rest_lengths(dc.Tokens(pa.array([[[]], []], pa.list_(pa.list_(pa.string()))))).tolist() == [0]


def test_summaries_are_stemmed_and_compared_in_one_step(spark):
    rows = [(1, "The cats sat. They ran.", "A cat sits. The cat ran!", "Cats"), (2, None, "x", ""), (3, "walking dogs", "dogs walked", "walks. dog.")]
    df = spark.createDataFrame([(i, "en", "src0", *x) for i, *x in rows], "doc_id LONG, dataset STRING, checkpoint STRING, reference STRING, summary_a STRING, summary_b STRING")
    scores = evaluate.summary_scores(df)
    assert scores._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = {(r.doc_id, r.metric): (r.a, r.b) for r in scores.collect()}
    assert got[3, "rougeL"] == (0.5, 1.0) and got[3, "rougeLsum"] == (0.5, 1.0) and got[3, "rouge1"] == (1.0, 1.0) and got[2, "rougeL"] == (0.0, 0.0)
    lines = [pa.array(x, pa.list_(pa.list_(pa.string()))) for x in (
        [[["a", "cats"], ["b"]], None, [], [["c"] * 4]], [[["cat"]], [["d"]], [], [["c"], ["c", "e"]]], [[[], ["b", "a"]], [], [["x"]], None])]
    whole = mt.hits_of(*lines, True).to_pylist()
    assert [(h["la"], h["lb"], h["ua"], h["ub"]) for h in whole] == [(1, 1, 1, 2), (0, 0, 0, 0), (0, 0, 0, 0), (2, 0, 2, 0)]
    parts = list(mt.hits_in_cuts(lines, True, 5))
    assert len(parts) > 1 and pa.concat_arrays(parts).to_pylist() == whole
    assert pa.concat_arrays(list(mt.hits_in_cuts([x.slice(1, 3) for x in lines], True, 5))).to_pylist() == whole[1:]


def test_shared_words_are_counted_for_many_rows_at_once(spark):
    r = random.Random(5)
    lists = [[None if r.random() < 0.1 else [r.choice("abcde") for _ in range(r.randrange(8))] for _ in range(70)] for _ in range(3)]
    lists[0][3], lists[1][3], lists[2][3] = ["a", "b"] * 40, ["b", "a", "a"] * 30, ["b"]
    columns = [pa.array(x, pa.list_(pa.string())) for x in lists]
    pairs = lambda x: Counter(zip(x, x[1:]))
    want = []
    for ref, *both in zip(*lists):
        met = [[None if c is None or ref is None else sum((Counter(c) & Counter(ref)).values()), sum((pairs(c or []) & pairs(ref or [])).values())] for c in both]
        want.append([None if x is None else len(x) for x in (ref, *both)] + [m[n] for n in (0, 1) for m in met])
    assert [[*x.values()] for x in mt.shared_of(*columns).to_pylist()] == want
    parts = [*mt.shared_in_cuts(columns, 20)]
    assert len(parts) > 5 and [[*x.values()] for p in parts for x in p.to_pylist()] == want
    assert [[*x.values()] for x in pa.concat_arrays([*mt.shared_in_cuts([x.slice(2, 9) for x in columns], 20)]).to_pylist()] == want[2:11]
    assert mt.shared_of(*[x.slice(0, 0) for x in columns]).to_pylist() == []


def test_long_sentences_are_not_searched_word_by_word(spark):
    words = lambda k: " ".join(f"w{i * k % 20011}" for i in range(20000))
    rows = [(i, "en", "s", words(1), words(3), words(7)) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id LONG, dataset STRING, checkpoint STRING, reference STRING, summary_a STRING, summary_b STRING")
    scores = evaluate.paired_scores(df)
    text = scores._jdf.queryExecution().executedPlan().toString()
    assert "array_intersect" not in text and text.count("ArrowEvalPython") == 1 and "Exchange" not in text
    a, b, c = ({*words(k).split()} for k in (1, 3, 7))
    got = {(r.doc_id, r.metric): (r.a, r.b) for r in scores.collect()}
    assert len(got) == 24 and got[2, "precision1"] == (len(a & b) / 20000, len(a & c) / 20000) and got[2, "recall2"][0] == 0.0


def test_span_lists():
    texts = ["In 1999 Anna Lee paid $5.20 to Bo.", None, "", "none here", "É Bo 7%"]
    assert en.span_lists(texts, True).to_pylist() == [en.spans(t, True) for t in texts]
    assert en.span_lists([]).to_pylist() == []
    assert list(en.byte_cuts(pa.array(["x" * en.CUT_BYTES, None, "y", "z" * en.CUT_BYTES]))) == [(0, 2), (2, 3), (3, 4)]


def test_cut_first_searches_once(spark):
    rows = [("x a y a", "a", "x  y a"), ("a.b*c\\E d\\Q e", "c\\E d", "a.b*\\Q e"), ("é😀b😀b", "😀b", "é😀b"), ("abc", "", "abc"), ("abc", None, "abc"), (None, "a", None), ("aXa", "aXa", "")]
    cut = spark.createDataFrame(rows, "t STRING, s STRING, want STRING").select(tx.cut_first(F.col("t"), F.col("s")).alias("got"), "want")
    assert "instr(" not in plan(cut)
    assert all(r.got == r.want for r in cut.collect())


def test_vectors_go_back_as_arrow(spark):
    rows = spark.createDataFrame([(i, "a b " * (i % 5)) for i in range(50)] + [(50, None)], "id LONG, t STRING").repartition(1)
    coded = vectors.encode_texts(rows, "id", "t", lambda: vectors.hashed_bag_encoder(8), batch=3)
    assert "MapInArrow" in plan(coded)
    got = {r.id: r.v for r in coded.collect()}
    assert len(got) == 51 and got[0] == got[50] == [0.0] * 8 and got[1] == got[46]


def test_contexts_are_not_shuffled(spark, monkeypatch):
    texts = {1: "A cat. A dog! A cat. ...", 2: "Alone", 3: None, 4: "", 5: "Été x. b, a a? " * 40, None: "One two. Two one."}
    docs = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id LONG, text STRING")
    wanted = {(r.doc_id, r.sid): r.score for r in scoring.hashed_context_similarity(docs, 8).collect()}
    for chars, calls in ((1 << 22, 32), (30, 32), (1 << 22, 1)):
        monkeypatch.setattr(vectors, "CONTEXT_CHARS", chars)
        monkeypatch.setattr(vectors, "CALLS", calls)
        found = vectors.encoded_context_similarity(docs, lambda: vectors.hashed_bag_encoder(8), batch=3)
        # no sort of texts, and what is shuffled are the given texts and short rows
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in text and "array_join" not in text and "split(" not in text
        got = {(r.doc_id, r.sid): r.score for r in found.collect()}
        assert got == pytest.approx(wanted, abs=2e-6) and found.count() == len(got)
    sents = ["a", "b c", "a"]
    assert [*vectors.contexts(sents)] == ["b c a", "a a", "a b c"] and [*vectors.contexts(["a"])] == [""] and [*vectors.contexts([])] == []


def test_default_encoder_counts_words_of_a_call(spark):
    texts = ["", "...", "a B a", "\u0130stanbul K9 \u00e9a9b \u212a", "x" * 100, "b a"]
    for buckets in (1, 7, 64):
        made = vectors.hashed_bag_encoder(buckets)(texts)
        for t, v in zip(texts, made):
            count = np.zeros(buckets)
            for w in re.findall("[a-z0-9]+", t.lower()):
                count[dc.hash_bucket(w, buckets)] += 1
            assert v == pytest.approx(count / (np.linalg.norm(count) or 1.0))


def test_token_likelihoods_count_the_corpus_once(spark, small):
    from salience.plans.scores import token_nll
    assert any("/vocabulary-" in f for f in token_nll(spark, small).inputFiles())


def test_scoring_writes_few_files(spark, monkeypatch):
    stored, write = {}, scoring.written

    def note(df, label):
        stored[label] = write(df, label)
        return stored[label]

    monkeypatch.setattr(scoring, "written", note)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(old, ("40", "false", "-1")):
        spark.conf.set(k, v)
    try:
        texts = [(i % 50 if i % 7 else None, " ".join(f"w{(i * j) % 997} w{j}." for j in range(1, 30))) for i in range(200)]
        docs = spark.createDataFrame(texts, "doc_id LONG, text STRING").repartition(60)
        monkeypatch.setattr(scoring, "HEAVY_WORDS", 200)
        got = sorted(map(str, scoring.count_pmi(docs).collect()))
        assert {label: len(df.inputFiles()) for label, df in stored.items()} == {"vocabulary": 8, "sentences": 8}
        assert stored["sentences"].count() == 200 * 29
        assert got == sorted(map(str, scoring.count_pmi(docs, scoring.corpus_counts(docs)).collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["call_prices", "external_judge"])
def test_short_rows_of_long_texts_are_gathered(spark, tmp_path, name):
    from salience.plans.catalog import QUERIES

    rows = [(i, f"The cat {i} sat. A dog ran. The cat ran {i}!", "en" if i % 2 else "de", f"src{i % 3}") for i in range(30)] + [(5, None, None, None), (None, "One. Two.", "fr", "src1")]
    spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    assert "REBALANCE_PARTITIONS_BY_NONE" in plan(found)
    assert found.count() == 31 and found.select("doc_id").distinct().count() == 30  # the words of document 5, in both of its rows
