"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from salience.llm.words import TokenSets
from salience.llm import counts, jaccard, lines, meeting, mixing, packing, pii, quality, scoring
from tests.conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark, rows):
    """Documents with further columns whose names operators use inside."""
    full = [(d, t, None, s, None) for d, t, s in rows]
    return spark.createDataFrame(full, DOCS).withColumn("id", F.lit("x")).withColumn("node", F.lit(1)).withColumn("size", F.lit("y")).withColumn(
        "key", F.lit(0)).withColumn("score", F.lit(2.0)).withColumn("label", F.lit("z"))


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def copies():
    """Near copies in a chain and in a star, equal texts, short, empty, null and long ones, a repeated id."""
    rng = random.Random(3)
    rows, base = [], words(rng, 120).split()
    for i in range(40):
        own = list(base)
        for _ in range(i % 4):
            own[rng.randrange(len(own))] = f"n{i}x{rng.randrange(9)}"
        rows.append((i, " ".join(own), "a"))
    chain = words(rng, 60).split()
    for i in range(12):
        chain = chain[:]
        chain[5 * i % 60] = f"c{i}"
        rows.append((100 + i, " ".join(chain), "b"))
    rows += [(200 + i, words(rng, rng.randrange(1, 90)), None) for i in range(40)]
    rows += [(300, "One  two\tthree", "a"), (301, "one two three", "c"), (302, "", "c"), (303, None, "c"), (304, " \n ", None), (305, "é É x", "c")]
    rows += [(306, words(rng, 4000, 30000), "long"), (306, words(rng, 50), "long")]
    rng.shuffle(rows)
    return rows


# private data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "phone": 8 <= len(digits) <= 15,
                  "card": 16 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(digits[::-1])) % 10 == 0}
            if ok[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_matches_patterns():
    rng = random.Random(1)
    parts = ["a.b@c.d", "@", "x@y", ".", "-", "+1 (212) 555-0100", "4111 1111 1111 1111", "4111-1111-1111-1111", "1.2.3.4", "1.2.3.4.5.6.7.8.9",
             "256.1.1.1", "00255.1.1.1", " ", "é", "٣", "user", "+", "5", "12", "(", ")", "a@b.c@d.e", "%_", "0000000000000000", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert [(s["kind"], s["start"], s["end"]) for s in pii.find(text) if s["base"]] == base_spans(text), text


def test_pii_method_adds_spans():
    kinds = lambda t: [s["kind"] for s in pii.find(t)]
    assert "iban" in kinds("pay to DE89 3704 0044 0532 0130 00 now") and "iban" not in kinds("pay to DE88 3704 0044 0532 0130 00 now")
    assert kinds("call me: 212 555 0100") == ["local_phone"] and kinds("it is 212 555 0100") == []
    assert kinds("ssn 123-45-6789") == ["identity"] and kinds("part 123-45-6789") == []
    assert kinds("amex 378282246310005") == ["short_card"] and kinds("no 378282246310005") == []
    assert pii.find("mail a@b.cc")[0]["score"] > pii.find("so   a@b.cc")[0]["score"]


def test_pii_account_numbers_before_words():
    ibans = lambda t: [t[s["start"]:s["end"]] for s in pii.find(t) if s["kind"] == "iban"]
    numbers = ["BE68 5390 0754 7034", "ES9121000418450200051332", "AT61 1904 3002 3457 3201", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"]
    for number in numbers:
        for behind in ("", " EUR 100", " BIC ABCDEF", " PAYMENT", " 100 200", " INTERNATIONAL TRANSFER", ", x", " Paid"):
            assert ibans(f"to {number}{behind}") == [number], behind
    assert ibans(" ".join(numbers)) == numbers
    assert ibans("AB12 CDEF GHIJ BE68 5390 0754 7034") == ["BE68 5390 0754 7034"]
    assert ibans("BE69 5390 0754 7034 EUR 100") == []
    assert ibans("AB12 " * 50_000) == []


def test_pii_rows_and_long_runs(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "x@y.zz", None), (3, "x@y.zz", None), (None, "é x@y.zz", "b"), (4, "a" * 300_000 + "1" * 300_000 + "+(" * 50_000, "c")]
    got = sorted(((r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"]]) for r in pii.find_pii(table(spark, rows)).collect()), key=str)
    mail = [("email", 0, 6)]
    assert got == sorted([(1, []), (2, []), (3, mail), (3, mail), (None, [("email", 2, 8)]), (4, [])], key=str)
    assert pii.find_pii(table(spark, [])).count() == 0


def test_pii_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in entry.queries()["op1_pii"](spark, SMALL).collect():
        want = base_spans(docs[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for k, _, _ in want) for x in BASE]


# near copies

def linked(rows, size, num, den):
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _, _) in enumerate(rows))


@pytest.mark.parametrize("size,num,den,cut", [(4, 85, 100, 2048), (5, 80, 100, 3)])
def test_jaccard(spark, copies, monkeypatch, size, num, den, cut):
    monkeypatch.setattr(meeting, "SLICE", cut)
    got = jaccard.link(table(spark, copies), size, num, den).collect()
    assert sorted(map(tuple, got)) == linked(copies, size, num, den)


def test_jaccard_edges(spark):
    assert jaccard.link(table(spark, [])).count() == 0
    rows = [(None, "a b c d e f", "a"), (1, "a b c d e f", None), (2, None, "a"), (3, "", "a")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.link(table(spark, rows)).collect()}
    assert got == {None: (2, None), 1: (2, 1), 2: (0, 2), 3: (0, 3)}


def test_count_tree_loses_nothing():
    rng = np.random.default_rng(0)
    from salience.llm.prefixes import Similarity

    sets = [np.unique(rng.integers(0, 1 << 40, rng.integers(20, 60))) for _ in range(150)]
    sets += [np.unique(np.append(s[1:], rng.integers(0, 1 << 40, 1))) for s in sets]
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = TokenSets(np.arange(len(sets)), np.zeros(len(sets)), owner, np.concatenate(sets))
    vectors, sizes = jaccard.count_vectors(flat), flat.sizes()
    similarity = Similarity(80, 100)
    a, b, spare = jaccard.CountTree(vectors, sizes).search(vectors, sizes, similarity)
    assert (spare >= 0).all()
    found = set(zip(a.tolist(), b.tolist()))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if len(np.intersect1d(x, y)) >= similarity.need(len(x), len(y)):
                assert (i, j) in found
    assert len(found) < 0.2 * len(sets) ** 2


# lines

def line_brute(rows, hashes, short=False):
    seen, out = [], collections.defaultdict(list)
    for d, h, t in sorted({(d, h, t) for (d, t, _), h in zip(rows, hashes) if t}):
        for i, content in enumerate(t.encode().lower().split(b"\n")):
            w = content.split()
            if len(w) >= 5:
                s = frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4))
                if any(100 * len(s & o) >= 80 * len(s | o) for o in seen):
                    out[d, h].append(i)
                seen.append(s)
            elif short and w:
                if frozenset([tuple(w)]) in seen:
                    out[d, h].append(i)
                seen.append(frozenset([tuple(w)]))
    return dict(out)


@pytest.mark.parametrize("cut", [2048, 2])
def test_lines(spark, copies, monkeypatch, cut):
    monkeypatch.setattr(meeting, "SLICE", cut)
    rng = random.Random(5)
    pool = [t for _, t, _ in copies if t and len(t) < 2000]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(4))) + ("\nend of it" if i % 3 else ""), None) for i in range(60)]
    rows += [(7, None, None), (7, "", None), (60, rows[3][1], None), (61, "a b\na b\n\nA b c d e\na  b c d e", None), (61, "a b\na b\n\nA b c d e\na  b c d e", None)]
    docs = table(spark, rows)
    hashes = [r[0] for r in spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(rows)], "i long, t string").select(
        F.xxhash64("t"), "i").orderBy("i").collect()]
    got = {(r["id"], r["hash"]): r["removed"] for r in lines.removed_lines(docs).collect()}
    assert got == line_brute(rows, hashes)
    left = lines.dedup_lines(docs)
    assert left.columns == docs.columns and left.count() == len(rows)
    assert {r["text"] for r in left.filter("doc_id = 61").collect()} == {"a b\na b\n\nA b c d e"}
    assert lines.removed_lines(table(spark, [])).count() == 0


def test_line_query_removes_repeated_short_lines(spark):
    """Lines of one to four words go when an earlier line has the same words; the others as before."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    want, seen = collections.defaultdict(set), set()
    for d, h, i in ((d, h, i) for (d, h), gone in line_brute([(r["doc_id"], r["text"], None) for r in docs], [r["h"] for r in docs]).items() for i in gone):
        want[d].add(i)
    repeated = 0
    for r in sorted(docs, key=lambda r: (r["doc_id"], r["h"])):
        for i, content in enumerate((r["text"] or "").encode().lower().split(b"\n")):
            w = tuple(content.split())
            if 0 < len(w) < 5:
                if w in seen:
                    want[r["doc_id"]].add(i)
                    repeated += 1
                seen.add(w)
    got = {r["doc_id"]: r["removed"] for r in entry.queries()["op7_lines"](spark, SMALL).collect()}
    assert repeated > 50 and got == {r["doc_id"]: ",".join(map(str, sorted(want[r["doc_id"]]))) for r in docs}


@pytest.mark.parametrize("size", [1, 2, 5])
def test_short_lines_are_one_token(size):
    column = pa.array(["a b\n\na  B\nx a b c d e", None, "", "a\na b", "b a\na b c d e f\na b c d\n \na b c d e f"])
    sets = TokenSets.of_lines(column, size, True)
    assert list(zip(sets.row.tolist(), sets.line.tolist())) == [(0, 0), (0, 2), (0, 3), (3, 0), (3, 1), (4, 0), (4, 1), (4, 2), (4, 4)]
    lengths = [2, 2, 6, 1, 2, 2, 6, 4, 6]
    assert sets.sizes().tolist() == [max(1, n - size + 1) for n in lengths]
    digest = sets.digests()[0].tolist()
    assert len({digest[0], digest[1], digest[4]}) == 1 and (digest[5] != digest[0] or size == 1) and digest[6] == digest[8]


# token counts

def best_count(word, vocabulary):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        extra = len(word[end - 1].encode())
        options = [(best[end - 1][0] + counts.BYTE_SCORE * extra, -best[end - 1][1] - extra)]
        options += [(best[s][0] + vocabulary[word[s:end]], -best[s][1] - 1) for s in range(end) if word[s:end] in vocabulary]
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_token_counts(spark, copies):
    rng = random.Random(2)
    scores = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 6))): -rng.random() * 9 for _ in range(60)}
    vocabulary = counts.Vocabulary(scores)
    found = {"".join(rng.choice("abéz") for _ in range(rng.randrange(0, 9))) for _ in range(800)}
    assert vocabulary.count(found) == {w: best_count(w, scores) for w in found}
    path = public_tokenizers.path("piece_bpe_32k.model")
    real = counts.Vocabulary.load(path).scores
    rows = [r for r in copies if r[0] != 306]
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in counts.token_counts(table(spark, rows), path).collect()}
    assert got == {d: (len((t or "").split()), sum(best_count(counts.MARK + w, real) for w in (t or "").split())) for d, t, _ in rows}
    assert counts.token_counts(table(spark, []), path).count() == 0


# quality

def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op5_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(got) > 50 and np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95
    assert all(r["predicted"] for r in got if r["quality"])


def test_quality_edges(spark):
    rows = [(i, f"plain words number {i} here" if i % 2 else f"LOUD!! {i}!! JUNK!! NOW!!", "a") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(30)] + [(None, 1, 0), (31, None, 0), (999, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows + [(None, None, None), (50, "", "b"), (51, "A" * 500_000, "b"), (39, rows[39][1], "a")])
    model = quality.fit(docs, labels)
    got = [(r["doc_id"], r["score"]) for r in quality.score(docs, model).collect()]
    assert len(got) == len(rows) + 4 and all(0 <= s <= 1 for _, s in got)
    assert all((s > 0.5) == bool(d % 2) for d, s in got if d is not None and 30 <= d < 40)
    assert {s for d, s in got if d in (None, 50)} == {model.prior}
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {1.0}
    assert quality.score(table(spark, []), model).count() == 0


def test_quality_votes_are_exact():
    rng = np.random.default_rng(1)
    x = np.abs(rng.standard_normal((60, quality.TERMS))).astype(np.float32)
    labels = rng.integers(0, 2, 60)
    model = quality.fit_vectors(x, labels)
    q = np.abs(rng.standard_normal((5, quality.TERMS))).astype(np.float32)
    for i, row in enumerate(q):
        v = (row * model.idf) @ model.directions
        cosine = model.vectors @ (v / np.linalg.norm(v))
        near = np.argsort(-cosine)[:quality.NEAREST]
        w = np.maximum(cosine[near], 0).astype(float) ** 4 + 1e-9
        assert math.isclose(quality.votes(model, q)[i], (w * labels[near]).sum() / w.sum(), rel_tol=1e-4)


# mixing

def mix_brute(rows):
    size = lambda t: len((t or "").encode().split())
    total = collections.Counter()
    for _, t, s in rows:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, rest, left = {}, sum(total.values()), set(order)
    while True:
        level = rest / sum(weight[s] for s in left) if left else 0
        over = {s for s in left if level * weight[s] > 3 * total[s]}
        if not over:
            return total, {**target, **{s: level * weight[s] for s in left}}
        for s in over:
            target[s] = float(3 * total[s])
            rest -= 3 * total[s]
        left -= over


@pytest.mark.parametrize("most,cut", [(4096, 50_000), (50, 1)])
def test_mixing(spark, copies, monkeypatch, most, cut):
    monkeypatch.setattr(mixing, "SLICE", cut)
    monkeypatch.setattr(mixing, "MOST", most)
    rows = copies + [(400 + i, "same size text", "hot") for i in range(200)] + [(700, "", "void"), (701, None, "void")]
    docs = table(spark, rows)
    got = mixing.mix(mixing.sized(docs)).collect()
    total, target = mix_brute(rows)
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == total[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-12, abs_tol=1e-12)
        assert 0 <= r["times"] <= 3
        taken[r["source"]] += r["times"] * r["size"]
    for s, n in taken.items():
        largest = max(len((t or "").split()) for _, t, x in rows if x == s)
        assert abs(n - target[s]) <= 2 * largest + 1
    # the same documents are taken however the groups are cut
    monkeypatch.setattr(mixing, "SLICE", 1 << 40)
    uncut = mixing.mix(mixing.sized(docs)).collect()
    assert sorted(map(repr, uncut)) == sorted(map(repr, got))
    monkeypatch.setattr(mixing, "SLICE", cut)
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns and whole.count() == sum(r["times"] for r in got)
    assert mixing.mix(mixing.sized(table(spark, []))).count() == 0
    assert "Python" not in whole._jdf.queryExecution().toString()


# language model

def test_scoring(spark, copies):
    rows = [r for r in copies if r[0] != 306] + [(None, "w1 w2", None)]
    docs = table(spark, rows)
    train = lambda d: d is not None and d % 5 != 1
    tokens = [(d, [*(t or "").encode().lower().split(), "end"]) for d, t, _ in rows]
    one, two, started = collections.Counter(), collections.Counter(), 0
    for d, w in tokens:
        if train(d):
            started += 1
            one.update(w)
            two.update(zip(["start", *w], w))
    n, v = sum(one.values()), len(one)
    whole = n + 0.5 * (v + 1)
    ctx = lambda c: started if c == "start" else one[c]
    bucket = lambda c: 0 if c <= 0 else int(math.log2(c)) + 1
    table_of = np.zeros((scoring.BUCKETS, scoring.BINS))
    for d, w in tokens:
        if train(d):
            for c, x in zip(["start", *w], w):
                k = ctx(c) - 1
                ratio = ((two[c, x] - 1) / k if k > 0 else 0) / ((one[x] - 0.5) / (whole - 1))
                place = min(max(1 + math.floor((math.log10(ratio) - scoring.LEAST_RATIO) / scoring.BIN), 1), scoring.BINS - 1) if ratio > 0 else 0
                table_of[bucket(k), place] += 1
    share = scoring.weights_from(table_of)
    got = {r["doc_id"]: r for r in scoring.score(docs, F.col("doc_id") % 5 != 1).collect()}
    assert len(got) == len(rows)
    for d, w in tokens:
        base = [(one[x] + 0.5) / whole for x in w]
        score = [share[bucket(ctx(c))] * (two[c, x] / ctx(c) if ctx(c) else 0) + (1 - share[bucket(ctx(c))]) * b for c, x, b in zip(["start", *w], w, base)]
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(one[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(map(math.log10, base)), rel_tol=1e-9) and math.isclose(r["score"], sum(map(math.log10, score)), rel_tol=1e-9)


def test_scoring_learns_weights_from_every_block(spark, copies, monkeypatch):
    """Scores do not depend on how documents are dealt into blocks; one block is held against brute force above."""
    docs = table(spark, [r for r in copies if r[0] != 306])
    score = lambda: {r["doc_id"]: r["score"] for r in scoring.score(docs, F.col("doc_id") % 5 != 1).collect()}
    one = score()
    monkeypatch.setattr(scoring, "BLOCK", 4)
    assert score() == pytest.approx(one, rel=1e-9)


def test_scoring_is_a_distribution(spark):
    """After any context the probabilities of all known tokens and of the unknown one add up to 1."""
    text = "a b a c a b b end"
    known = sorted({*text.split(), ""})
    docs = table(spark, [(0, text, None), (2, text, None)] + [(11 + 10 * i, f"a {w}".strip(), None) for i, w in enumerate([*known, "zzz"])] + [(1, "a", None)])
    got = {r["doc_id"]: r["score"] for r in scoring.score(docs, F.col("doc_id") % 2 == 0).collect()}
    begins = {r["doc_id"]: r["score"] for r in scoring.score(table(spark, [(0, text, None), (2, text, None), (1, "a", None), (3, "", None)]), F.col("doc_id") % 2 == 0).collect()}
    assert got[1] == pytest.approx(begins[1])
    assert scoring.score(table(spark, []), F.col("doc_id") > 0).count() == 0


def test_scoring_learns(spark):
    got = [r for r in entry.queries()["op8_scoring"](spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    assert sum(r["score"] for r in got) > 0.9 * sum(r["base_score"] for r in got)


# packing

def check_pieces(pieces, docs, length=4096):
    """``docs``: texts by id, in which an id may stand several times."""
    tokenizer = Tokenizer.from_file(TOKENIZER)
    ids = {d: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for d, t in docs.items()}
    sequences = collections.defaultdict(list)
    total = collections.Counter()
    for p in pieces:
        own = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(own) and zlib.crc32(own[p["start"]:p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        total[p["doc_id"]] += p["length"]
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= length and at & (at - 1) == 0
    return total, ids


def test_packing(spark, copies):
    rows = [r for r in copies if r[0] != 306] + [(306, " ".join(f"w{i}" for i in range(9000)), "a"), (501, "don't <|endoftext|> it's 12% ÅNGSTRÖM ﬁ é", None)]
    rows += [(600, "again and again", None)] * 3
    total, ids = check_pieces(packing.pack(table(spark, rows), TOKENIZER).collect(), {d: t for d, t, _ in rows})
    times = collections.Counter(d for d, _, _ in rows)
    assert total == {d: len(ids[d]) * n for d, n in times.items()}
    assert packing.pack(table(spark, []), TOKENIZER).count() == 0


def test_curve_keeps_like_documents_together():
    """Documents of one kind lie closer along the curve than documents of different kinds."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(("alpha beta gamma" if k else "zwölf über straße").split()) for _ in range(60)).encode() for k in (0, 1) for _ in range(30)]
    order = np.argsort(packing.curve_keys(texts), kind="stable") // 30
    assert np.count_nonzero(np.diff(order)) <= 4
