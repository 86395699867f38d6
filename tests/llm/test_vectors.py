"""Vector searches against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from salience.llm import blocks, neighbours, pivots
from salience.llm.hilbert import hilbert_keys
from tests.conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(6)
    centers = rng.standard_normal((6, 12))
    rows = [(i, (centers[i % 6] + 0.3 * rng.standard_normal(12)).astype(np.float32).tolist(), i % 6) for i in range(700)]
    rows += [(1000 + i, rows[20][1], 0) for i in range(60)]
    rows += [(2000, None, 0), (2020, [float("nan")] * 12, 0), (2040, [None] + [1.0] * 11, 0), (2060, [0.0] * 12, 0), (2080, [1.0, 2.0], 0), (2100, [float("inf")] * 12, 0), (2120, [], 0)]
    return rows + [rows[40]]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x")).withColumn("query", F.lit("y")).withColumn("v", F.lit(0)).withColumn("cell", F.lit(0))


def best(rows, k, scale=None, zero=False):
    usable = {}
    for i, v, _ in rows:
        if v is not None and len(v) == 12 and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            x = np.array(v, np.float32).astype(float)
            usable[i] = np.floor(scale * x) if scale else x
    out = {}
    for q in usable:
        if q % 20 == 0:
            ranked = sorted((-float((usable[q] * x).sum()), i) for i, x in usable.items() if i != q)[:k]
            out[q] = [(i, -s) for s, i in ranked]
    return out


def grouped(found):
    out = {}
    for r in sorted(found, key=lambda r: (r["query"], r["rank"])):
        out.setdefault(r["query"], []).append((r["id"], r["score"]))
        assert r["rank"] == len(out[r["query"]])
    return out


def test_pivots(spark, vectors, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 50)
    monkeypatch.setattr(blocks, "QUERIES", 7)
    assert grouped(pivots.search(frame(spark, vectors), F.col("id") % 20 == 0).collect()) == best(vectors, 20, 64, zero=True)
    assert pivots.search(frame(spark, []), F.col("id") % 20 == 0).count() == 0
    few = vectors[:5]
    assert grouped(pivots.search(frame(spark, few), F.col("id") % 20 == 0).collect()) == best(few, 20, 64, zero=True)


def test_neighbours(spark, vectors, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 50)
    monkeypatch.setattr(blocks, "QUERIES", 7)
    got, want = grouped(neighbours.nearest(frame(spark, vectors), F.col("id") % 20 == 0).collect()), best(vectors, 20)
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in got)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    true = {(q, i): s for q, found in best(vectors, 10_000).items() for i, s in found}
    for q, found in got.items():
        assert all(math.isclose(s, true[q, i], rel_tol=1e-12) for i, s in found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
    assert neighbours.nearest(frame(spark, []), F.col("id") % 20 == 0).count() == 0


def test_neighbours_of_few_candidates_are_all(spark):
    rng = np.random.default_rng(11)
    few = [(20 * i, rng.standard_normal(12).astype(np.float32).tolist(), 0) for i in range(12)]
    got, want = grouped(neighbours.nearest(frame(spark, few), F.col("id") % 20 == 0).collect()), best(few, 20)
    assert {q: [i for i, _ in found] for q, found in got.items()} == {q: [i for i, _ in found] for q, found in want.items()}
    copies = [(i, few[0][1], 0) for i in range(1500)] + [(20_000 + 20 * i, v, 0) for i, (_, v, _) in enumerate(few[1:4])]
    got, want = grouped(neighbours.nearest(frame(spark, copies), F.col("id") % 20 == 0).collect()), best(copies, 20)
    assert got.keys() == want.keys() and all(len(found) == 20 for found in got.values())


def test_neighbours_recall_on_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    x = np.array([r[1] for r in rows], np.float64)
    ids = np.array([r[0] for r in rows])
    got = entry.queries()["op4_neighbours"](spark, SMALL).collect()
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[q]
        scores[q] = -np.inf
        want = set(ids[np.argsort(-scores)[:20]].tolist())
        hits += len(want & {r["vec_id"] for r in got if r["query_id"] == ids[q]})
        total += len(want)
    assert hits >= 0.9 * total


def test_hilbert_neighbours_are_adjacent():
    """Consecutive keys are cells that touch, and every cell has a key of its own."""
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
