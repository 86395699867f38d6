"""Benchmark passages in documents, against a plain scan."""

import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from salience.llm import decontamination as dec


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items, window):
    """(n_words, hit places, ids) by comparing every place with every window."""
    words = words_of(text)
    hit, ids = set(), set()
    for item, t in items:
        own = words_of(t)
        m = min(len(own), window)
        for p in range(len(own) - m + 1 if m else 0):
            for i in range(len(words) - m + 1):
                if words[i:i + m] == own[p:p + m]:
                    hit |= set(range(i, i + m))
                    ids.add("" if item is None else str(item))
    return len(words), hit, sorted(ids)


def seen(row):
    return row["n_words"], {i for s in row["spans"] for i in range(s["first"], s["end"])}, row["items"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=40), min_size=1, max_size=6), st.lists(st.lists(st.sampled_from("abcd"), max_size=9), max_size=5), st.integers(2, 5))
def test_search_on_few_words(docs, items, window):
    rows = pa.table({"item": pa.array([str(i) for i in range(len(items))], pa.string()), "words": pa.array([" ".join(x).encode() for x in items], pa.binary())})
    patterns, ids = dec.patterns_of(rows, window)
    n, starts, ends, names = dec.found_in(pa.array([" ".join(d) for d in docs]), patterns, ids)
    for d, count, s, e, found in zip(docs, n, starts.to_pylist(), ends.to_pylist(), names.to_pylist()):
        want = plain(" ".join(d), [(i, " ".join(x)) for i, x in enumerate(items)], window)
        assert (count, {i for a, b in zip(s, e) for i in range(a, b)}, found) == want
        assert all(b < a for b, a in zip(e, s[1:]))


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "ÄHRE", "ñu", "x1", "2024", "été", "日本"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " - ", "\x00", "_"]) for _ in range(n))
    items = [(i, text(rng.choice([3, 9, 10, 14, 40]))) for i in range(12)] + [(40, None), (41, ""), (42, "-- ."), (None, "solitary"), (7, "beta"), (7, "beta")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(30)]
    docs += [(100 + i, text(200) + items[i % 12][1].upper().replace("ÄHRE", "ähre").replace("ä", "Ä") + text(3)) for i in range(12)]
    docs += [(200, None), (201, ""), (202, " \n"), (None, items[3][1]), (None, items[3][1]), (100, docs[3][1]), (300, text(30_000) + items[4][1])]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("x")).withColumn("items", F.lit(1)).withColumn("item_id", F.lit(1))
    return d, spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(2)).withColumn("words", F.lit(2))


def test_against_plain_scan(spark, tables):
    docs, items = tables
    key = lambda x: repr(x)
    want = sorted(((i, *plain(t, items, 10)) for i, t in docs), key=key)
    found = dec.search(*frames(spark, docs, items)).collect()
    assert sorted(((r["doc_id"], *seen(r)) for r in found), key=key) == want
    assert sum(1 for w in want if w[2]) > 12


def test_blocks_of_a_large_benchmark(spark, tables, monkeypatch):
    docs, items = tables
    whole = sorted(map(repr, dec.search(*frames(spark, docs, items)).collect()))
    monkeypatch.setattr(dec, "SLICE", 3)
    monkeypatch.setattr(dec, "BLOCK_BYTES", 800)
    assert sorted(map(repr, dec.search(*frames(spark, docs, items)).collect())) == whole


def test_empty_tables(spark, tables):
    docs, items = tables
    d, b = frames(spark, docs, items)
    assert all(r["spans"] == [] and r["items"] == [] for r in dec.search(d, b.limit(0)).collect())
    assert dec.search(d.limit(0), b).collect() == []
