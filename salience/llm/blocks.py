"""Best partners of many queries, found block by block.

Data rows lie in cells and have a position inside their cell; a query visits cells with a range of positions. Both are
cut into blocks of bounded size, whatever a cell holds, and every pair of blocks of a visited cell meets in one group,
where the products are taken at once and only the best ``k`` per query leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS = 8192
QUERIES = 4096
AT_ONCE = 256


def matrix(column, dtype) -> np.ndarray:
    """Rows of a binary column as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)


def usable(vectors: DataFrame, id_col: str, vec_col: str, zero: bool) -> DataFrame:
    """(id, x array<double>) of vectors without null or non-finite components; ``zero`` tells whether zero ones stay.

    Vectors of another length than most have no product with the rest and are left out too.
    """
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).alias("id"), x.alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull())
    rows = rows.filter(F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))) & (F.size("x") > 0))
    if not zero:
        rows = rows.filter(F.exists("x", lambda c: c != 0))
    usual = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("x") == (usual["n"] if usual else 0))


def cuts_into(counts: dict[int, int], cells: int, most: int) -> Column:
    """Number of blocks of each cell as an array; the number of cells is bounded by the callers."""
    return F.array(*[F.lit(max(1, -(-counts.get(c, 0) // most))) for c in range(cells)])


def best_partners(data: DataFrame, visits: DataFrame, cells: int, k: int, dtype: str, whole: bool) -> DataFrame:
    """(query, id, score): for each query at least its ``k`` best of the rows it reaches; a row may come from several cells.

    data: id, cell, pos, v; visits: query, cell, lo, hi, v; vectors are binary rows of ``dtype``. Scores are whole
    numbers if ``whole``. A row is never its own partner.
    """
    sizes = {r["cell"]: r["n"] for r in data.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    wanted = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    subs = F.element_at(cuts_into(sizes, cells, ROWS), F.col("cell") + 1)
    parts = F.element_at(cuts_into(wanted, cells, QUERIES), F.col("cell") + 1)
    left = data.select("id", "cell", "pos", "v", F.pmod(F.xxhash64("id"), subs).cast("int").alias("sub"),
                       F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    right = visits.select("query", "cell", "lo", "hi", "v", F.pmod(F.xxhash64("query"), parts).cast("int").alias("part"),
                          F.explode(F.sequence(F.lit(0), subs - 1)).alias("sub"))
    kind = pa.int64() if whole else pa.float64()

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if rows.num_rows and asked.num_rows:
            x, ids, pos = matrix(rows["v"], dtype), rows["id"].to_numpy(), rows["pos"].to_numpy()
            q, qid = matrix(asked["v"], dtype), asked["query"].to_numpy()
            lo, hi = asked["lo"].to_numpy(), asked["hi"].to_numpy()
            xs = x.astype(np.float64)
            for at in range(0, len(q), AT_ONCE):
                s = slice(at, at + AT_ONCE)
                scores = q[s].astype(np.float64) @ xs.T
                # repeated rows of a query's own id are the query as well
                scores[(ids == qid[s, None]) | (pos < lo[s, None]) | (pos > hi[s, None])] = -np.inf
                for i, row in enumerate(scores):
                    if len(row) > k:
                        least = np.partition(row, len(row) - k)[len(row) - k]
                        slack = 0.0 if whole else 1e-9 * max(1.0, abs(least)) if np.isfinite(least) else 0.0
                        near = np.flatnonzero((row >= least - slack) & (row > -np.inf))
                    else:
                        near = np.flatnonzero(row > -np.inf)
                    if whole:
                        exact = row[near].astype(np.int64)
                    else:
                        # one order of summation for every pair, so equal vectors score alike
                        exact = (xs[near] * q[at + i].astype(np.float64)).sum(axis=1)
                    if len(near) > k:
                        first = np.lexsort((ids[near], -exact))[:k]
                        near, exact = near[first], exact[first]
                    out[0].append(np.full(len(near), qid[at + i]))
                    out[1].append(ids[near])
                    out[2].append(exact)
        joined = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table([pa.array(joined[0], pa.int64()), pa.array(joined[1], pa.int64()), pa.array(joined[2], kind)], names=["query", "id", "score"])

    keys = ["cell", "sub", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, f"query long, id long, score {'long' if whole else 'double'}")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best distinct partners of each query, with ranks from 1; ties go to the smaller id."""
    once = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query").orderBy(F.desc("score"), "id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
