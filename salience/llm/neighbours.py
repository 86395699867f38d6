"""Approximate nearest neighbours by inner product, along several Hilbert curves.

Each curve projects the vectors to ``DIMS`` orthogonal directions of its own, turned and shifted against the others, and
orders them by Hilbert key. Vectors are scaled by the largest norm and get one more component that makes all norms equal,
so the nearest by direction are the largest by inner product; queries get 0 there. A curve's keys are cut at approximate
quantiles, bounded in number, which give every key its place in [0, 1]; ranges of places are the cells of the index. A
query is compared with all vectors within ``width`` of its place on any curve, and the exact products rank them.

The width is measured, not guessed: for at most ``TRIED`` queries the true neighbours among all vectors are found, and
the width is what reaches ``AIM`` of them on at least one curve. Clustered vectors get narrow windows; for vectors without
structure in many dimensions no curve helps, and windows grow until they do. Queries whose windows hold fewer than ``k``
others, though there are more, are compared with all vectors.

Null, zero, non-finite and odd-length vectors take no part. Equal vectors share a place and tie by id. Repeated ids of
one vector count once with their best product. No vectors, no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salience.llm.blocks import best_partners, matrix, ranked, usable
from salience.llm.graph import stored
from salience.llm.hilbert import directions, even, hilbert_keys
from salience.session import ship

CURVES = 8
DIMS = 4
BITS = 12
QUANTILES = 1024
TRIED = 128
AIM = 0.95
MOST_CELLS = 1024


def curve_keys(x: np.ndarray, largest: float, query: bool) -> np.ndarray:
    """Hilbert keys on every curve; x as rows."""
    norms = np.linalg.norm(x, axis=1)
    if query:
        lifted = np.column_stack([x / norms[:, None], np.zeros(len(x))])
    else:
        lifted = np.column_stack([x / largest, np.sqrt(np.maximum(0.0, 1.0 - (norms / largest) ** 2))])
    dims = lifted.shape[1]
    keys = np.empty((len(x), CURVES), np.int64)
    for c in range(CURVES):
        shift = np.random.default_rng(7000 + c).uniform(-0.5, 0.5, min(DIMS, dims))
        points = even(lifted @ directions(dims, DIMS, 4000 + c) * np.sqrt(dims) + shift)
        keys[:, c] = hilbert_keys((points * (1 << BITS)).astype(np.int64), BITS)
    return keys


def places(keys: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(cuts[c], keys[:, c], side="left") / max(1, len(cuts[c])) for c in range(len(cuts))])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", aim: float = AIM) -> DataFrame:
    """(query, rank, id, score) for the rows that ``is_query``, a condition on column ``id``, marks."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_col, vec_col, zero=False)
    single = dict(vectors.dtypes)[vec_col] == "array<float>"
    dtype = "<f4" if single else "<f8"
    most = rows.agg(F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)))).first()[0]
    flat = rows.select(F.col("id").cast("long").alias("id"), "x", is_query.alias("asks"))

    def keyed(query: bool):
        def run(batches):
            for batch in batches:
                x = np.array(batch.column("x").to_pylist(), np.float64).reshape(batch.num_rows, -1)
                keys = curve_keys(x, most, query) if len(x) else np.zeros((0, CURVES), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([r.tobytes() for r in x.astype(dtype)], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))],
                    names=["id", "v", "keys"])

        return run

    schema = "id long, v binary, keys array<bigint>"
    indexed = flat.drop("asks").mapInArrow(keyed(False), schema)
    asking = flat.filter("asks").drop("asks").mapInArrow(keyed(True), schema)
    empty = spark.createDataFrame([], "query long, rank int, id long, score double")
    if most is None:
        return empty
    shares = F.array(*[F.lit(i / QUANTILES) for i in range(1, QUANTILES)])
    found = indexed.agg(*[F.percentile_approx(F.col("keys")[c], shares, F.lit(10 * QUANTILES)).alias(f"c{c}") for c in range(CURVES)]).first()
    cuts = [np.array(found[f"c{c}"]) for c in range(CURVES)]
    width = _width(indexed, asking, cuts, dtype, k, aim)
    cells = int(min(MOST_CELLS, max(1, np.ceil(1 / max(width, 1e-9)))))

    def to_cells(batches):
        for batch in batches:
            at = places(np.array(batch.column("keys").to_pylist(), np.int64).reshape(-1, CURVES), cuts)
            cell = np.minimum((at * cells).astype(np.int64), cells - 1) + np.arange(CURVES) * cells
            take = pa.array(np.repeat(np.arange(len(at)), CURVES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), pa.array(cell.ravel().astype(np.int32)), pa.array(at.ravel()), batch.column("v").take(take)],
                names=["id", "cell", "pos", "v"])

    def to_visits(batches):
        for batch in batches:
            at = places(np.array(batch.column("keys").to_pylist(), np.int64).reshape(-1, CURVES), cuts)
            row, cell, lo, hi = [], [], [], []
            for i in range(len(at)):
                for c in range(CURVES):
                    low, high = at[i, c] - width, at[i, c] + width
                    for b in range(max(0, min(cells - 1, int(low * cells))), min(cells - 1, int(high * cells)) + 1):
                        row.append(i), cell.append(c * cells + b), lo.append(low), hi.append(high)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), pa.array(cell, pa.int32()), pa.array(lo, pa.float64()), pa.array(hi, pa.float64()), batch.column("v").take(take)],
                names=["query", "cell", "lo", "hi", "v"])

    data = indexed.mapInArrow(to_cells, "id long, cell int, pos double, v binary")
    visits = asking.mapInArrow(to_visits, "query long, cell int, lo double, hi double, v binary")
    near = stored(ranked(best_partners(data, visits, CURVES * cells, k, dtype, whole=False), k), "near")
    others = min(k, rows.select("id").distinct().limit(k + 1).count() - 1)
    full = near.groupBy("query").count().filter(F.col("count") >= others)
    short = stored(asking.join(full.select(F.col("query").alias("id")), "id", "left_anti").select(F.col("id").alias("query"), "v"), "short")
    if others < 1 or short.isEmpty():
        return near
    everywhere = indexed.select("id", F.lit(0).alias("cell"), F.lit(0.0).alias("pos"), "v")
    anywhere = short.select("query", F.lit(0).alias("cell"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), "v")
    rest = ranked(best_partners(everywhere, anywhere, 1, k, dtype, whole=False), k)
    return near.join(short.select("query").distinct(), "query", "left_anti").unionByName(rest)


def _width(indexed: DataFrame, asking: DataFrame, cuts: list[np.ndarray], dtype: str, k: int, aim: float) -> float:
    """The window that reaches ``aim`` of the true neighbours of some queries, found among all vectors."""
    tried = asking.orderBy(F.xxhash64("id"), "id").limit(TRIED).collect()
    if not tried:
        return 0.0
    q = np.array([np.frombuffer(r["v"], dtype) for r in tried]).astype(np.float64)
    qid = np.array([r["id"] for r in tried])
    at = places(np.array([r["keys"] for r in tried], np.int64), cuts)

    def gaps(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = matrix(batch.column("v"), dtype).astype(np.float64), batch.column("id").to_numpy()
            there = places(np.array(batch.column("keys").to_pylist(), np.int64), cuts)
            scores = q @ x.T
            scores[qid[:, None] == ids] = -np.inf
            top = np.argpartition(-scores, min(k, len(x)) - 1, axis=1)[:, :k]
            gap = np.abs(there[top] - at[:, None, :]).min(axis=2)
            rows = np.repeat(np.arange(len(q)), top.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(scores, top, 1).ravel()), pa.array(gap.ravel())],
                names=["query", "id", "score", "gap"])

    best = indexed.mapInArrow(gaps, "query long, id long, score double, gap double").filter(F.col("score") > float("-inf"))
    order = W.partitionBy("query").orderBy(F.desc("score"), "id")
    reach = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).agg(F.percentile("gap", aim)).first()[0]
    return float(reach or 0.0) + 1.0 / QUANTILES
