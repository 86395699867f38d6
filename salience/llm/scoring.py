"""Language-model scores of documents by deleted interpolation of n-gram estimates.

The probability of a token is a mixture of the maximum-likelihood estimate after its predecessor, ``c(v, w) / c(v)``, and
the smoothed share of the token alone, ``(c(w) + 0.5) / (N + 0.5 (V + 1))``, where one part of the latter stands for all
unknown tokens. The mixture weight depends on how often the context was seen, in buckets of doubling counts; for each
bucket expectation-maximization finds it on held-out counts: each event of some training documents is scored with
its own occurrence taken out of all counts. A text starts in a context of its own and ends with an end token.

Counts cover every n-gram of every training document. Documents are dealt into blocks. A block asks for its distinct
n-grams, one packed row per range of hashes, together with its own training counts; the range adds up the counts of all
blocks and answers each block in the order it asked. So an n-gram travels once per block and not once per occurrence, no
table is broadcast, and frequent n-grams are added up before they are shuffled. Memory per task is bounded by a block and
by a range, whose number grows with the corpus. N-grams are told apart by 64-bit hashes.

The weights are learned on all training documents. From blocks only histograms of the ratio of both estimates per bucket
are gathered, a fixed number of rows.

Null and empty texts are the end token alone. Repeated rows and ids are scored, and learned from, as often as they occur.
With nothing to learn from, every token is unknown and no context counts. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salience.llm.asking import packed, packed_keys, ranges, unpacked, unpacked_keys
from salience.llm.graph import stored
from salience.llm.words import Words, mixed
from salience.session import ship

BLOCK = 2048
BUCKETS = 48
#: Bins of the base-10 logarithm of the ratio of both estimates; bin 0 holds ratio 0.
BIN, LEAST_RATIO, BINS = 0.02, -8.0, 900
ROUNDS = 200
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Block:
    """The n-grams of some texts: tokens, their contexts, and the distinct ones in the order of their hashes."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        n = np.diff(words.bounds)
        self.lengths = n + 1
        self.starts = np.cumsum(self.lengths) - self.lengths
        token = np.full(int(self.lengths.sum()), _END)
        token[np.arange(len(words.hash)) + np.repeat(np.arange(len(n)), n)] = words.hash
        context = np.empty_like(token)
        context[1:] = token[:-1]
        context[self.starts] = _START
        pair = mixed(mixed(context + _ODD) + token)
        self.single, self.token = np.unique(token, return_inverse=True)
        self.pairs, self.pair = np.unique(pair, return_inverse=True)
        # a text's first token has no token before it
        self.context = np.concatenate([[0], self.token[:-1]]) if len(token) else self.token
        self.first = np.zeros(len(token), bool)
        self.first[self.starts] = True

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        learned = np.repeat(train, self.lengths)
        return (np.bincount(self.token[learned], minlength=len(self.single)), np.bincount(self.pair[learned], minlength=len(self.pairs)))


def _requests(parts_bits: int):
    """Rows (kind, part, block, keys, counts) of a block; a part is a range of hashes."""

    def ask(rows: pa.Table) -> pa.Table:
        block = Block(rows["text"])
        counts = block.counts(rows["train"].to_numpy(zero_copy_only=False))
        out = []
        for kind, (keys, n) in enumerate(zip((block.single, block.pairs), counts)):
            out += [(kind, part, rows["block"][0].as_py(), packed_keys(keys[lo:hi]), packed(n[lo:hi])) for part, lo, hi in ranges(keys, parts_bits)]
        columns = list(zip(*out))
        return pa.table([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()),
                         pa.array(columns[3], pa.binary()), pa.array(columns[4], pa.binary())], names=["kind", "part", "block", "keys", "counts"])

    return ask


def _answer(rows: pa.Table) -> pa.Table:
    """Rows (block, kind, part, totals, seen, tokens); seen and tokens, of the part, stand on one row only."""
    asked = [unpacked_keys(k) for k in rows["keys"].to_pylist()]
    counts = np.concatenate([unpacked(c) for c in rows["counts"].to_pylist()])
    keys, place = np.unique(np.concatenate(asked), return_inverse=True)
    totals = np.bincount(place, weights=counts, minlength=len(keys)).astype(np.int64)
    mine = np.split(totals[place], np.cumsum([len(a) for a in asked])[:-1])
    first = [i == 0 for i in range(rows.num_rows)]
    return pa.table([rows["block"], rows["kind"], rows["part"], pa.array([packed(m) for m in mine], pa.binary()),
                     pa.array([int((totals > 0).sum()) if f else 0 for f in first], pa.int64()),
                     pa.array([int(totals.sum()) if f else 0 for f in first], pa.int64())],
                    names=["block", "kind", "part", "totals", "seen", "tokens"])


def _bucket(count: np.ndarray) -> np.ndarray:
    """0 for no occurrence, then one bucket for each doubling."""
    return np.where(count > 0, np.minimum(BUCKETS - 1, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1), 0)


class _Counted:
    """A block with its answers: for each token the counts of itself, of its context and of both."""

    def __init__(self, rows: pa.Table, answers: pa.Table, texts_started: int):
        answers = answers.sort_by([("kind", "ascending"), ("part", "ascending")])
        kinds = answers["kind"].to_numpy()
        totals = [unpacked(t).astype(np.int64) for t in answers["totals"].to_pylist()]
        single = np.concatenate([t for t, k in zip(totals, kinds) if k == 0])
        pairs = np.concatenate([t for t, k in zip(totals, kinds) if k == 1])
        self.block = Block(rows["text"])
        if len(single) != len(self.block.single) or len(pairs) != len(self.block.pairs):
            raise RuntimeError("a block's answers do not fit its questions")
        self.train = np.repeat(rows["train"].to_numpy(zero_copy_only=False), self.block.lengths)
        self.alone = single[self.block.token]
        self.context = np.where(self.block.first, texts_started, single[self.block.context])
        self.both = pairs[self.block.pair]


def weights_from(histogram: np.ndarray) -> np.ndarray:
    """The weight of the bigram estimate per bucket, by expectation-maximization on counts of ratios."""
    middle = np.concatenate([[0.0], 10.0 ** (LEAST_RATIO + BIN * (np.arange(1, BINS) - 0.5))])
    out = np.zeros(BUCKETS)
    for bucket in range(1, BUCKETS):
        n = histogram[bucket]
        if not n.sum():
            # no event of this size: contexts are trusted as those of the bucket below
            out[bucket] = out[bucket - 1]
            continue
        share = 0.5
        for _ in range(ROUNDS):
            share = float((n * (share * middle / (share * middle + 1 - share))).sum() / n.sum())
            share = min(max(share, 1e-6), 1 - 1e-6)
        out[bucket] = share
    return out


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score and score; ``train``, a condition on ``docs``, says what to learn from."""
    ship(docs.sparkSession)
    blocks = max(1, -(-docs.count() // BLOCK))
    bits = max(0, (blocks - 1).bit_length())
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(train, F.lit(False)).alias("train"),
                       F.pmod(F.xxhash64(F.col(id_col), text), F.lit(blocks)).alias("block"))
    kind = docs.schema[id_col].dataType.simpleString()
    asked = rows.groupBy("block").applyInArrow(_requests(bits), "kind int, part int, block long, keys binary, counts binary")
    answers = stored(asked.groupBy("kind", "part").applyInArrow(_answer, "block long, kind int, part int, totals binary, seen long, tokens long"), "answers")
    known = answers.filter("kind = 0").agg(F.sum("seen").alias("v"), F.sum("tokens").alias("n")).first()
    types, tokens = int(known["v"] or 0), int(known["n"] or 0)
    started = rows.filter("train").count()
    whole = tokens + 0.5 * (types + 1)

    def histogram(group: pa.Table, told: pa.Table) -> pa.Table:
        c = _Counted(group, told, started)
        t = c.train
        context, both, alone = c.context[t] - 1, c.both[t] - 1, c.alone[t] - 1
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(context > 0, both / context, 0.0) / ((alone + 0.5) / (whole - 1))
            bins = np.where(ratio > 0, np.clip(1 + np.floor((np.log10(ratio) - LEAST_RATIO) / BIN), 1, BINS - 1), 0).astype(np.int64)
        cell, n = np.unique(_bucket(context) * BINS + bins, return_counts=True)
        return pa.table([pa.array(cell), pa.array(n)], names=["cell", "n"])

    gathered = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(histogram, "cell long, n long")
    table = np.zeros(BUCKETS * BINS, np.int64)
    for r in gathered.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        table[r["cell"]] = r["n"]
    share = weights_from(table.reshape(BUCKETS, BINS))

    def scored(group: pa.Table, told: pa.Table) -> pa.Table:
        c = _Counted(group, told, started)
        base = (c.alone + 0.5) / whole
        weight = share[_bucket(c.context)]
        with np.errstate(divide="ignore", invalid="ignore"):
            after = np.where(c.context > 0, c.both / c.context, 0.0)
        at = c.block.starts
        add = lambda x: pa.array(np.add.reduceat(x, at))
        return pa.table([group["id"], pa.array(c.block.lengths), add((c.alone > 0).astype(np.int64)), pa.array(np.full(len(at), tokens)),
                         add(np.log10(base)), add(np.log10(weight * after + (1 - weight) * base))],
                        names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        scored, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
