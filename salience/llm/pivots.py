"""Exact largest inner products through a pivot-distance index.

Vectors get one more component that makes all norms equal, so a larger product with a query is a smaller distance to it.
Each vector is keyed by its nearest of ``PIVOTS`` pivots, drawn by a hash of the id, and its distance to it; approximate
quantiles of the distances cut a pivot's vectors into ``RINGS`` annuli. By the triangle inequality no vector of an annulus
is nearer to a query than the gap between the query's own distance to the pivot and the annulus. A query takes the annuli
in the order of these gaps, in two rounds; after the first its k-th best product bounds what an annulus must
offer, and it stops when none is left that can. A last part of the bound is a slack for rounding, so ties are never lost.

Null, non-finite and odd-length vectors take no part; zero ones do. Ties go to the smaller id. Repeated ids count once.
No vectors, no rows. Components are whole numbers; products must stay below 2**53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salience.llm.blocks import best_partners, matrix, ranked, usable
from salience.session import scratch_path, ship

PIVOTS = 16
RINGS = 8
#: Annuli a query has taken after each round.
ROUNDS = (2, PIVOTS * RINGS)


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(0.0, square))


def search(vectors: DataFrame, is_query: Column, scale: float = 64.0, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query, rank, id, score) over floor(scale * x), for rows that ``is_query``, a condition on column ``id``, marks."""
    spark = vectors.sparkSession
    ship(spark)
    whole = usable(vectors, id_col, vec_col, zero=True).select(
        F.col("id").cast("long").alias("id"), F.transform("x", lambda c: F.floor(c * F.lit(scale)).cast("double")).alias("x"))

    def packed(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), "<f8").reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array((x * x).sum(axis=1) if len(x) else [], pa.float64())],
                names=["id", "v", "square"])

    rows = whole.mapInArrow(packed, "id long, v binary, square double")
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    most = rows.agg(F.max("square")).first()[0]
    if not drawn:
        return spark.createDataFrame([], "query long, rank int, id long, score long")
    pivots = lifted(np.array([np.frombuffer(r["v"], "<f8") for r in drawn]), most)
    slack = 1e-6 * (1.0 + np.sqrt(most))

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                d = distances(lifted(matrix(batch.column("v"), "<f8"), most), pivots)
                pivot = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("v"), pa.array(pivot.astype(np.int32)), pa.array(d[np.arange(len(d)), pivot])],
                    names=["id", "v", "pivot", "pos"])

    near = rows.mapInArrow(keyed, "id long, v binary, pivot int, pos double")
    shares = F.array(*[F.lit(i / RINGS) for i in range(1, RINGS)])
    cuts = {r["pivot"]: np.array(r["cuts"]) for r in near.groupBy("pivot").agg(F.percentile_approx("pos", shares, F.lit(1000)).alias("cuts")).collect()}

    def to_rings(batches):
        for batch in batches:
            pivot, pos = batch.column("pivot").to_numpy(), batch.column("pos").to_numpy()
            ring = np.zeros(len(pivot), np.int32)
            for p in np.unique(pivot):
                here = pivot == p
                ring[here] = np.searchsorted(cuts[p], pos[here], side="right")
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array((pivot * RINGS + ring).astype(np.int32)), batch.column("pos"), batch.column("v")],
                names=["id", "cell", "pos", "v"])

    data = near.mapInArrow(to_rings, "id long, cell int, pos double, v binary")
    edges = {r["cell"]: (r["lo"], r["hi"]) for r in data.groupBy("cell").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).collect()}
    cells = np.array(sorted(edges))
    inner, outer = np.array([edges[c][0] for c in cells]), np.array([edges[c][1] for c in cells])
    of_pivot = cells // RINGS

    def visits(first: int, last: int):
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = matrix(batch.column("v"), "<f8")
                d = distances(np.column_stack([q, np.zeros(len(q))]), pivots)[:, of_pivot]
                gap = np.maximum(0.0, np.maximum(inner - d, d - outer))
                order = np.argsort(gap, axis=1, kind="stable")[:, first:last]
                least = np.array([-np.inf if b is None else b for b in batch.column("least").to_pylist()], float)
                reach = np.sqrt(np.maximum(0.0, (q * q).sum(axis=1) + most - 2 * least)) + slack
                take, at = np.nonzero(np.take_along_axis(gap, order, 1) <= reach[:, None])
                cell = order[take, at]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(take)), pa.array(cells[cell].astype(np.int32)), pa.array(d[take, cell] - reach[take]),
                     pa.array(d[take, cell] + reach[take]), batch.column("v").take(pa.array(take))],
                    names=["query", "cell", "lo", "hi", "v"])

        return run

    asking = rows.filter(is_query).select("id", "v")
    best = None
    for first, last in zip((0, *ROUNDS), ROUNDS):
        bound = asking.withColumn("least", F.lit(None).cast("double")) if best is None else asking.join(
            best.filter(F.col("rank") == k).select(F.col("query").alias("id"), F.col("score").cast("double").alias("least")), "id", "left")
        asked = bound.mapInArrow(visits(first, last), "query long, cell int, lo double, hi double, v binary")
        found = best_partners(data, asked, PIVOTS * RINGS, k, "<f8", whole=True)
        if best is not None:
            found = found.unionByName(best.select("query", "id", "score"))
        best = ranked(found, k)
        if last != ROUNDS[-1]:
            # a table in the shared folder: the next round reads it twice
            path = scratch_path(spark, "best")
            best.write.parquet(path)
            best = spark.read.parquet(path)
    return best
