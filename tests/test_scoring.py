import collections
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from salience.functions import text as tx
from salience.operators import compare, scoring, select, vectors
from salience.operators.scale import even_join, rank_by_digest, rank_by_number, smallest_digests

DOCS = [
    (1, "The cat sat. The cat ran home. A dog slept."),
    (2, "Only one sentence here"),
    (3, "..."),
    (4, "Same line. Same line. Same line. Other words now. Same line."),
    (5, "!!! a b c. ?? b c d. b c. z"),
    (6, "The cat sat. The cat ran home. A dog slept."),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id LONG, text STRING")


def split(text):
    import re
    out = [re.sub(r"\s+", " ", p).strip() for p in re.findall(r"[^.!?]+[.!?]*", text)]
    return [s for s in out if s]


def toks(s):
    import re
    return re.findall("[a-z0-9]+", s.lower())


def overlap_f(a, b):
    x, y = collections.Counter(a), collections.Counter(b)
    both = sum((x & y).values())
    return 0.0 if not a or not b or not both else 2 * both / (len(a) + len(b))


def brute(n):
    out = {}
    grams = lambda t: [tuple(t[i:i + n]) for i in range(len(t) - n + 1)]
    for d, text in DOCS:
        s = split(text)
        for i, x in enumerate(s):
            rest = toks(" ".join(y for j, y in enumerate(s) if j != i))
            out[d, i] = round(overlap_f(grams(toks(x)), grams(rest)), 6)
    return out


def collected(df):
    return {(r["doc_id"], r["sid"]): r["score"] for r in df.collect()}


def test_rouge1_is_the_overlap_with_the_rest(docs):
    assert collected(scoring.rouge1(docs)) == pytest.approx(brute(1))


def test_rouge2_handles_borders(docs):
    assert collected(scoring.rouge2(docs)) == pytest.approx(brute(2))


def test_rouge_l(docs):
    from tests.test_text import naive_lcs
    want = {}
    for d, text in DOCS:
        s = split(text)
        for i, x in enumerate(s):
            rest = [w for j, y in enumerate(s) if j != i for w in toks(y)]
            want[d, i] = round(2 * naive_lcs(toks(x), rest) / max(1, len(toks(x)) + len(rest)), 6)
    assert collected(scoring.rouge_l(docs)) == pytest.approx(want)


@pytest.mark.parametrize("heavy", [100_000, 3])
def test_count_pmi(docs, monkeypatch, heavy):
    """The same scores whether words are looked up in the broadcast or joined by the shuffle."""
    monkeypatch.setattr(scoring, "HEAVY_WORDS", heavy)
    corpus = collections.Counter(w for _, t in DOCS for w in toks(t))
    total, kinds, mu = sum(corpus.values()), len(corpus), 64.0
    want = {}
    for d, text in DOCS:
        s = split(text)
        doc = collections.Counter(w for x in s for w in toks(x))
        for i, x in enumerate(s):
            own = collections.Counter(toks(x))
            n_s, n_d = sum(own.values()), sum(doc.values())
            if not own:
                want[d, i] = 0.0
                continue
            bits = 0.0
            for w, c in own.items():
                p0 = (corpus[w] + 1) / (total + kinds)
                bits += c * math.log2((doc[w] - c + mu * p0) / (n_d - n_s + mu) / p0)
            want[d, i] = 0.0 if n_s == n_d else round(bits / n_s, 6)
    assert collected(scoring.count_pmi(docs)) == pytest.approx(want, abs=2e-6)


def test_likelihood_pmi(spark):
    rows = [(1, 0, "cond", 0, 1.0), (1, 0, "cond", 1, 3.0), (1, 0, "marg", 0, 4.0), (1, 0, "base", 0, 2.0), (1, 0, "base", 1, 6.0)]
    nll = spark.createDataFrame(rows, "doc_id LONG, sid LONG, kind STRING, pos LONG, nll DOUBLE")
    assert scoring.likelihood_pmi(nll).first()["score"] == pytest.approx(2.0 / math.log(2), abs=1e-6)
    assert scoring.baseline_pmi(nll).first()["score"] == pytest.approx(2.0 / math.log(2), abs=1e-6)
    assert scoring.baseline_pmi(nll, per_token=False).first()["score"] == pytest.approx(4.0 / math.log(2), abs=1e-6)


def test_selection_ties_and_empty_documents(docs):
    picks = select.best(scoring.rouge1(docs))
    pairs = {r["doc_id"]: r for r in select.masked_pairs(docs, picks).collect()}
    assert pairs[4]["sid"] == 0 and pairs[4]["document"].startswith("<mask> Same line.")
    assert pairs[3]["document"] == "" and pairs[3]["summary"] == ""
    assert pairs[2]["document"] == "<mask>" and pairs[2]["summary"] == "Only one sentence here"
    assert pairs[1]["summary"] == pairs[6]["summary"]


def test_top_k_and_candidates(docs):
    scores = scoring.rouge1(docs)
    top = select.top_k(scores, 2).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in top} == {1: 2, 2: 1, 4: 2, 5: 2, 6: 2}
    lists = select.candidate_lists(docs, scores, 2)
    direct = {r["doc_id"]: r["sid"] for r in select.best(scores).collect()}
    assert {r["doc_id"]: r["sid"] for r in select.combine_candidates(lists).collect()} == direct
    one = lists.filter("doc_id = 1").withColumn("labels", F.array(F.lit(1), F.lit(0)))
    assert select.combine_candidates(one, "labels").first()["sid"] == lists.filter("doc_id = 1").first()["sids"][1]
    short = lists.filter("doc_id = 1").withColumn("labels", F.array(F.lit(1)))
    assert select.combine_candidates(short, "labels").first()["sid"] == lists.filter("doc_id = 1").first()["sids"][0]


def test_partitioning_does_not_matter(docs):
    a = collected(scoring.overlap_and_pmi(docs).select("doc_id", "sid", F.col("pmi").alias("score")))
    b = collected(scoring.overlap_and_pmi(docs.repartition(3, "text")).select("doc_id", "sid", F.col("pmi").alias("score")))
    assert a == b


def test_compare(spark):
    s = "x" * 20
    rows = [(1, "q", "q", "q"), (2, s + "1", s + "2", s + "1"), (3, "a", "b", "b"), (4, "a", "b", "c"), (5, "a", "a", "c")]
    make = lambda i: spark.createDataFrame([(r[0], "<mask>", r[i]) for r in rows], "doc_id LONG, document STRING, summary STRING")
    two = {r["doc_id"]: r["class"] for r in compare.compare_two(make(1), make(2)).collect()}
    assert two == {1: "same", 2: "almost", 3: "different", 4: "different", 5: "same"}
    three = compare.compare_three(make(1), make(2), make(3))
    assert {r["doc_id"]: r["class"] for r in three.collect()} == {1: "all_same", 2: "b_differs", 3: "a_differs", 4: "all_differ", 5: "c_differs"}
    report = {r["item"]: r["n"] for r in compare.agreement_report(three).collect()}
    assert sum(report[k] for k in ("all_same", "all_differ", "a_differs", "b_differs", "c_differs")) == 5
    assert report["agree_ab"] == 2 and report["almost_ab"] == 1


def test_even_join_is_an_inner_join(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    per = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2).filter("k <> 7")
    got = even_join(rows, per, ["k"], "n", most=5)
    assert got.count() == rows.filter("k <> 7").count()
    assert got.filter("v <> 2 * k").count() == 0


def test_ranks(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3 == 0).cast("int").alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    want = {}
    for g in (0, 1):
        rows = sorted((r["h"], r["id"]) for r in df.filter(f"g = {g}").collect())
        want.update({i: k for k, (_, i) in enumerate(rows)})
    assert {r["id"]: r["idx"] for r in rank_by_digest(df, ["g"], "h").collect()} == want
    assert {r["id"] for r in smallest_digests(df, ["g"], "h", 17).collect()} == {i for i, k in want.items() if k < 17}
    sparse = spark.range(2000).select((F.col("id") * F.col("id")).alias("key"))
    got = {r["key"]: r["idx"] for r in rank_by_number(sparse, "key", buckets=64).collect()}
    assert got == {i * i: i for i in range(2000)}


def test_greedy_match_over_tiles(spark, monkeypatch):
    import numpy as np
    rng = np.random.default_rng(3)
    c, r = rng.normal(size=(9, 4)), rng.normal(size=(7, 4))
    rows = [(1, "cand", i, False, [float(x) for x in v]) for i, v in enumerate(c)] + [(1, "ref", i, False, [float(x) for x in v]) for i, v in enumerate(r)]
    rows.append((1, "ref", 99, True, [100.0, 0.0, 0.0, 0.0]))
    df = spark.createDataFrame(rows, "pair_id LONG, side STRING, pos LONG, special BOOLEAN, v ARRAY<DOUBLE>")
    u = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sim = u(c) @ u(r).T
    p, q = sim.max(1).mean(), sim.max(0).mean()
    for tile in (128, 4):
        monkeypatch.setattr(vectors, "TILE", tile)
        got = vectors.greedy_match(df).first()
        assert (got["precision"], got["recall"]) == pytest.approx((p, q), abs=1e-6)
        assert got["f1"] == pytest.approx(2 * p * q / (p + q + 1e-8), abs=1e-6)


def test_salience_and_pooling(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (1, 2, [0.0, 2.0]), (2, 3, [3.0, 4.0])], "g LONG, k LONG, v ARRAY<FLOAT>")
    got = {r["k"]: r["score"] for r in vectors.salience(v, "g", "k", 2).collect()}
    assert got == pytest.approx({0: 0.0, 1: 1 / math.sqrt(2), 2: 1 / math.sqrt(2), 3: 0.0}, abs=1e-6)
    t = spark.createDataFrame([(1, True, [1.0, 1.0]), (1, True, [3.0, 1.0]), (1, False, [9.0, 9.0])], "id LONG, mask BOOLEAN, v ARRAY<FLOAT>")
    assert vectors.pooled(t, "id", 2).first()["v"] == pytest.approx([2 / math.sqrt(5), 1 / math.sqrt(5)])


def test_model_job_and_reuse(spark):
    texts = spark.createDataFrame([(i, "same" if i % 2 else f"text {i}") for i in range(20)], "id LONG, t STRING")
    calls = vectors.encode_texts(texts, "id", "t", lambda: vectors.hashed_bag_encoder(8), batch=3)
    assert calls.count() == 20
    got = vectors.score_once(texts, "t", lambda d: d.select("context_hash", F.length("text").alias("n")))
    assert {r["id"]: r["n"] for r in got.collect()} == {i: 4 if i % 2 else len(f"text {i}") for i in range(20)}
    assert vectors.distinct_contexts(texts, "t").count() == 11


def test_position_slice(spark):
    df = spark.range(10).select((F.col("id") * 7).alias("k"))
    assert sorted(r["k"] for r in select.position_slice(df, "k", 3, 99).collect()) == [7 * i for i in range(3, 10)]


def test_seeded_subset_is_the_same_for_all_checkpoints(spark):
    df = spark.range(60).select((F.col("id") % 20).alias("doc"), (F.col("id") / 20).cast("int").alias("ckpt"), F.lit("d").alias("ds"))
    got = select.seeded_subset(df, "ds", "doc", 5).groupBy("doc").count().collect()
    assert len(got) == 5 and all(r["count"] == 3 for r in got)


def test_context_similarity_by_encoder(docs):
    """The general encoder job and the shortcut for linear encoders agree on what a sentence shares with the rest."""
    from salience.operators.vectors import encoded_context_similarity, hashed_bag_encoder
    encode = hashed_bag_encoder(64)
    want = {}
    for d, text in DOCS:
        s = split(text)
        for i, x in enumerate(s):
            a, b = encode([x, " ".join(y for j, y in enumerate(s) if j != i)])
            want[d, i] = round(float(a @ b), 6)
    assert collected(encoded_context_similarity(docs, hashed_bag_encoder)) == pytest.approx(want, abs=2e-6)
    linear = collected(scoring.hashed_context_similarity(docs, 4096))
    exact = {}
    for d, text in DOCS:
        s = split(text)
        for i, x in enumerate(s):
            own = collections.Counter(toks(x))
            rest = collections.Counter(w for j, y in enumerate(s) if j != i for w in toks(y))
            size = math.sqrt(sum(c * c for c in own.values()) * sum(c * c for c in rest.values()))
            exact[d, i] = 0.0
            if own:
                exact[d, i] = round(sum(c * rest[w] for w, c in own.items()) / size, 6) if size else 0.0
    assert linear == pytest.approx(exact, abs=2e-6)


def test_hot_pairs_are_cut(spark, monkeypatch):
    """One pair with almost all tokens gives the same result however it is cut."""
    import numpy as np
    rng = np.random.default_rng(5)
    rows = [(1, s, i, False, [float(x) for x in rng.normal(size=3)]) for s in ("cand", "ref") for i in range(40)]
    rows += [(2, s, 0, False, [1.0, 0.0, 0.0]) for s in ("cand", "ref")]
    df = spark.createDataFrame(rows, "pair_id LONG, side STRING, pos LONG, special BOOLEAN, v ARRAY<DOUBLE>")
    want = sorted(map(tuple, vectors.greedy_match(df).collect()))
    monkeypatch.setattr(vectors, "TILE", 4)
    for cuts in (1, 3, 64):
        monkeypatch.setattr(vectors, "CUTS", cuts)
        assert sorted(map(tuple, vectors.greedy_match(df).collect())) == want


def test_row_wise_queries_do_not_shuffle(spark, monkeypatch):
    import __spark_entry__ as entry
    from salience.plans import derive
    from tests.conftest import SMALL
    # but for dealing out a scan that has fewer parts than there are cores
    assert derive.documents(spark, SMALL).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(derive, "spread", lambda df: df)
    names = ["sentences", "sentence_bodies", "other_sentences", "cut_contexts", "masked_documents", "inserted_mask", "metric_tokens", "rouge1_pairs",
             "rouge1_scores", "rouge2_scores", "rougeL_scores", "hashed_context_similarity", "one_sentence_per_line", "encoded_sentences",
             "entity_annotation", "gated_annotation", "unsupported_entities", "replaced_summaries", "repaired_summaries", "intrinsic_negatives"]
    for name in names:
        plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name


def test_vectors_without_a_direction(spark):
    from salience.operators import vectors
    rows = [("g", 1, [0.0, 0.0]), ("g", 2, [1.0, 0.0]), ("g", 3, [-1.0, 0.0]), ("h", 4, [1.0, 1.0])]
    got = vectors.salience(spark.createDataFrame(rows, "g STRING, k LONG, v ARRAY<FLOAT>"), "g", "k", 2).collect()
    assert {r["k"]: r["score"] for r in got} == {1: 0.0, 2: pytest.approx(-1.0), 3: pytest.approx(-1.0), 4: 0.0}
    masked = spark.createDataFrame([("t", False, [1.0, 2.0]), ("u", True, [3.0, 4.0])], "id STRING, mask BOOLEAN, v ARRAY<FLOAT>")
    assert {r["id"]: r["v"] for r in vectors.pooled(masked, "id", 2).collect()} == {"t": [0.0, 0.0], "u": pytest.approx([0.6, 0.8])}
    tokens = [(1, "cand", 0, False, [1.0, 0.0]), (2, "cand", 0, False, [0.0, 0.0]), (2, "ref", 0, False, [1.0, 0.0])]
    match = vectors.greedy_match(spark.createDataFrame(tokens, "pair_id LONG, side STRING, pos LONG, special BOOLEAN, v ARRAY<FLOAT>")).collect()
    assert {r["pair_id"]: r["f1"] for r in match} == {1: 0.0, 2: 0.0}


def test_pairs_in_one_evaluation(spark, small):
    """Scores are computed once per document, and no filter carries the splitting or the scoring along."""
    from salience.operators import scoring, select
    from salience.plans.registry import table

    plan = select.pairs_in_row(scoring.rouge1_list(table(spark, small, "documents")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert all("[a-z0-9]+" not in line for line in plan.splitlines() if line.lstrip(" +-:").startswith("Filter"))


@given(st.lists(st.lists(st.lists(st.sampled_from("abc"), max_size=6), max_size=5), max_size=4), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_counts_of_a_batch(docs, buckets):
    """Flat counts of many documents at once equal counts of one sentence after the other."""
    from collections import Counter

    import pyarrow as pa

    from salience.functions import documents as dc

    t = dc.Tokens(pa.array(docs, pa.list_(pa.list_(pa.string()))))
    words, pairs, cosines = [], [], []
    for doc in docs:
        for i, own in enumerate(doc):
            rest = [w for k, s in enumerate(doc) if k != i for w in s]
            left, near = Counter(rest), Counter(zip(rest, rest[1:]))
            words.append(sum(min(n, left[w]) for w, n in Counter(own).items()))
            pairs.append(sum(min(n, near[g]) for g, n in Counter(zip(own, own[1:])).items()))
            x, y = (Counter(dc.hash_bucket(w, buckets) for w in s) for s in (own, rest))
            size = sum(n * n for n in x.values()) * sum(n * n for n in y.values())
            cosines.append(sum(n * y[b] for b, n in x.items()) / size ** 0.5 if size else 0.0)
    assert dc.shared_words(t).tolist() == words
    assert dc.shared_pairs(t).tolist() == pairs
    assert dc.hashed_cosines(t, buckets).tolist() == pytest.approx(cosines)


@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcde"), max_size=14), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_way_back_through_bit_rows(text, other, stride):
    """Places on a longest common subsequence, as the walk through the whole table finds them."""
    from salience.functions import matching

    best = [[0] * (len(other) + 1) for _ in range(len(text) + 1)]
    for i, x in enumerate(text):
        for j, y in enumerate(other):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    want, i, j = set(), len(text), len(other)
    while i and j:
        if text[i - 1] == other[j - 1]:
            i, j = i - 1, j - 1
            want.add(i)
        elif best[i][j - 1] > best[i - 1][j]:
            j -= 1
        else:
            i -= 1
    kept, matching.STRIDE = matching.STRIDE, stride
    try:
        bits = matching.covered(matching.positions(text), len(text), other)
    finally:
        matching.STRIDE = kept
    assert {i for i in range(len(text)) if bits >> i & 1} == want
    assert matching.lcs_length(text, other) == best[-1][-1]
