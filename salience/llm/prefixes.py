"""Rarity-ordered prefixes of token sets, computed without a row per token.

Tokens are hashes below 2**``TOKEN_BITS``. The global order is: tokens below ``share`` of the hash space by how many sets
hold them, then by hash; all other tokens behind them by hash. Two sets of sizes a and b with overlap of at least
``need(a, b)`` share a token among the first ``prefix(n)`` of each in any global order, so only the low tokens of a set (or
as many more as its prefix takes) are looked at. A low token that one set alone has comes first in the order and joins
nothing, so its place is all that counts; sets with enough of them are done at once. What is left is small for texts that
are not copies. Counts come from packed asks of blocks of sets (``asking``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salience.llm.asking import ASKED, SHARED, packed, packed_keys, ranges, shared_keys, unpacked, unpacked_keys
from salience.llm.graph import stored
from salience.llm.words import TOKEN_BITS

#: Tokens of a block, and of a range of hashes, as they are meant to be; both are counts, not caps.
BLOCK_TOKENS, RANGE_TOKENS = 300_000, 500_000


class Similarity:
    """Jaccard of at least num/den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        #: low tokens have to hold a prefix and leave room for frequent ones
        self.share = min(1.0, (den - num) / den * 5 / 4)
        self.low = int(self.share * (1 << TOKEN_BITS))

    def need(self, a, b):
        """Smallest overlap of linked sets of these sizes."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def prefix(self, n):
        """Tokens of a set of size n that must hold one of every linked set."""
        return n - -(-self.num * n // self.den) + 1


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy()
    return values, np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))


def _packed_nodes(rows: pa.Table) -> pa.Table:
    """The nodes of a block in one row."""
    nodes = np.sort(rows["node"].to_numpy()).astype(np.uint64)
    return pa.table([rows["block"].slice(0, 1), pa.array([packed_keys(nodes)], pa.binary()), pa.array([None], pa.binary())], names=["block", "keys", "counts"])


def _prefix_rows(similarity: Similarity, carried: list[str]):
    """The tokens of a block's sets that stand in a prefix and that several sets have, with their places."""

    def pick(sets: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["node", "n", "key", "place", *carried]
        told = answers.filter(pc.is_valid(answers["counts"]))
        kept = answers.filter(pc.is_null(answers["counts"]))
        if not sets.num_rows or not told.num_rows or not kept.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.int32())] + [pa.array([], pa.int64())] * len(carried), names=names)
        nodes = np.concatenate([unpacked_keys(k) for k in kept["keys"].to_pylist()]).astype(np.int64)
        sets = sets.filter(pa.array(np.isin(sets["node"].to_numpy(), nodes)))
        keys = np.concatenate([unpacked_keys(k) for k in told["keys"].to_pylist()]).astype(np.int64)
        totals = np.concatenate([unpacked(c) for c in told["counts"].to_pylist()]).astype(np.int64)
        order = np.argsort(keys)
        keys, totals = keys[order], totals[order]
        values, row = _lists(sets["low"])
        at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
        hit = keys[at] == values
        values, row, count = values[hit], row[hit], totals[at[hit]]
        n, n_low = sets["n"].to_numpy(), sets["n_low"].to_numpy()
        low = values < similarity.low
        # alone: low tokens that no other set has, which come first
        alone = n_low - np.bincount(row[low], minlength=len(n))
        by = np.lexsort((values, np.where(low, count, 0), ~low, row))
        values, row, low = values[by], row[by], low[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        # of the other tokens a set gave no more than its prefix takes
        place = np.where(low, alone[row] + rank, n_low[row])
        keep = ~low | (place < similarity.prefix(n[row]))
        row = row[keep]
        return pa.table([pa.array(sets["node"].to_numpy()[row]), pa.array(n[row]), pa.array(values[keep]), pa.array(place[keep].astype(np.int32)),
                         *[pa.array(sets[c].to_numpy()[row]) for c in carried]], names=names)

    return pick


def shared_prefixes(sets: DataFrame, kept: DataFrame, similarity: Similarity, carried: list[str] | None = None) -> DataFrame:
    """(node, n, key, place) and the ``carried`` LONG columns of the sets, stored: tokens in the prefix of a kept set that another set has.

    ``sets``, a stored table, has node, n, n_low and low (an array of tokens); ``kept`` has node and names one set of each
    group of equal ones. ``place`` is the token's position in the set's order, from 0.
    """
    size = sets.agg(F.count("*").alias("rows"), F.sum(F.greatest("n_low", F.col("n") * (1 - similarity.num / similarity.den) + 1)).alias("tokens")).first()
    tokens = int(size["tokens"] or 0)
    bits = max(0, (tokens // RANGE_TOKENS).bit_length())
    # nodes are numbered row by row within a partition, so neighbours share a block
    step = max(1, int(BLOCK_TOKENS * size["rows"] / max(1, tokens)))
    carried = carried or []
    in_blocks = sets.select(F.expr(f"node div {step}").alias("block"), "node", "n", "n_low", "low", *carried)

    def ask(batches):
        for batch in batches:
            block = batch.column("block").to_numpy()
            values, row = _lists(batch.column("low"))
            of = block[row]
            out = []
            for b in np.unique(block):
                keys, counts = np.unique(values[of == b].astype(np.uint64), return_counts=True)
                out += [(part, int(b), packed_keys(keys[lo:hi]), packed(counts[lo:hi])) for part, lo, hi in ranges(keys, bits, TOKEN_BITS)]
            if out:
                part, block_of, keys, counts = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.int32()), pa.array(block_of, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())],
                    names=["part", "block", "keys", "counts"])

    answers = in_blocks.select("block", "low").mapInArrow(ask, ASKED).groupBy("part").applyInArrow(shared_keys, SHARED)
    nodes = kept.select(F.expr(f"node div {step}").alias("block"), "node").groupBy("block").applyInArrow(_packed_nodes, SHARED)
    rows = in_blocks.groupBy("block").cogroup(answers.unionByName(nodes).groupBy("block")).applyInArrow(
        _prefix_rows(similarity, carried), "node long, n long, key long, place int" + "".join(f", {c} long" for c in carried))
    return stored(rows, "prefixes")
