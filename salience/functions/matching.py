"""Longest common subsequences as Arrow UDFs; they read whole rows and need no shuffle.

A row of the dynamic program over ``a`` is one integer: a bit is 0 where the length of the subsequence grows. Taking in a
token of ``b`` is an addition and a subtraction, so a pair costs len(a) * len(b) / 64 machine steps.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salience.functions.documents import CUT_TOKENS, LCS, Tokens, by_tokens, ranges
from salience.functions.stemming import stems_of

#: The tokens of a reference and two summaries, and per summary its common subsequence with the reference and the hits of their lines.
HITS = T.StructType([*[T.StructField(c, T.ArrayType(T.StringType())) for c in ("tr", "ta", "tb")], *[T.StructField(c, T.LongType()) for c in ("la", "lb", "ua", "ub")]])
#: The tokens of a reference and two summaries, and how many words and word pairs each summary shares with the reference.
SHARED = T.StructType([T.StructField(c, T.LongType()) for c in ("nr", "na", "nb", "a1", "b1", "a2", "b2")])
#: Rows between two that are kept for the way back; those in between are computed again.
STRIDE = 64
#: Places of words that are held at once.
CUT_HITS = 1 << 21


def positions(a: Sequence) -> dict:
    """For each token the bits of its places in ``a``."""
    where: dict = {}
    for i, t in enumerate(a):
        where[t] = where.get(t, 0) | (1 << i)
    return where


def _rows(where: dict, full: int, row: int, b: Iterable) -> Iterable[int]:
    for t in b:
        hit = where.get(t)
        if hit:
            keep = row & hit
            row = ((row + keep) | (row - keep)) & full
        yield row


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence."""
    if len(a) > len(b):
        a, b = b, a
    full = row = (1 << len(a)) - 1
    for row in _rows(positions(a), full, row, b):
        pass
    return len(a) - row.bit_count()


def covered(where: dict, n: int, b: Sequence) -> int:
    """Bits of the places of a text of ``n`` tokens on one longest common subsequence with ``b``.

    The way back goes from the ends: equal tokens are taken, otherwise it steps back in ``b`` if the length grows at this
    place of the text, and in the text if not. Every ``STRIDE``-th row is kept and the rows of one stride at a time are
    made again.
    """
    full = (1 << n) - 1
    kept = [full]
    for j, row in enumerate(_rows(where, full, full, b), 1):
        if j % STRIDE == 0:
            kept.append(row)
    out, i, j, base, rows = 0, n, len(b), -1, []
    while i and j:
        if base != (j - 1) // STRIDE:
            base = (j - 1) // STRIDE
            rows = list(_rows(where, full, kept[base], b[base * STRIDE:(base + 1) * STRIDE]))
        bit = 1 << (i - 1)
        if where.get(b[j - 1], 0) & bit:
            out, i, j = out | bit, i - 1, j - 1
        else:
            grows = ~rows[j - 1 - base * STRIDE] & (bit | (bit - 1))
            # nothing happens on the way down to the highest place where the length grows or the token stands
            here = where.get(b[j - 1], 0) & (bit - 1)
            top = max(grows.bit_length(), here.bit_length())
            if top < i:
                i = top
            else:
                j -= 1
    return out


def union_hits(ref_lines: Sequence[Sequence], cand_lines: Sequence[Sequence]) -> int:
    """Tokens of the reference lines covered by any candidate line, each token used at most as often as the candidate has it.

    A reference line is held only against candidate lines that share a token with it.
    """
    having: dict = {}
    for k, line in enumerate(cand_lines):
        for t in set(line):
            having.setdefault(t, []).append(k)
    found: Counter = Counter()
    for line in ref_lines:
        where = positions(line)
        places = 0
        for k in sorted({k for t in where for k in having.get(t, ())}):
            places |= covered(where, len(line), cand_lines[k])
        for t, bits in where.items():
            found[t] += (bits & places).bit_count()
    left = Counter(t for line in cand_lines for t in line)
    return sum(min(n, left[t]) for t, n in found.items())


@F.arrow_udf(T.LongType())
def lcs(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else lcs_length(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int64())


@F.arrow_udf(T.LongType())
def line_hits(ref: pa.Array, cand: pa.Array) -> pa.Array:
    return pa.array([union_hits(r or [], c or []) for r, c in zip(ref.to_pylist(), cand.to_pylist())], pa.int64())


def hits_of(ref: pa.Array, a: pa.Array, b: pa.Array, stem: bool) -> pa.Array:
    """``HITS`` of lists of token lists."""
    lines = [[row or [] for row in (stems_of(x) if stem else x).to_pylist()] for x in (ref, a, b)]
    r, a, b = flat = [[list(chain.from_iterable(row)) for row in x] for x in lines]
    found = [*([lcs_length(x, y) for x, y in zip(c, r)] for c in (a, b)), *([union_hits(x, y) for x, y in zip(lines[0], c)] for c in lines[1:])]
    return pa.StructArray.from_arrays([*[pa.array(x, pa.list_(pa.string())) for x in flat], *[pa.array(x, pa.int64()) for x in found]], [f.name for f in HITS])


def _tokens_in_rows(lines: pa.Array) -> np.ndarray:
    lines = lines.fill_null([]) if lines.null_count else lines
    return np.diff(lines.values.offsets.to_numpy()[lines.offsets.to_numpy()])


def hits_in_cuts(columns: tuple[pa.Array, ...], stem: bool, most: int = CUT_TOKENS) -> Iterator[pa.Array]:
    """The same for slices of rows that hold a bounded number of tokens."""
    sizes = sum(_tokens_in_rows(x) for x in columns)
    for lo, hi in ranges(np.concatenate([[0], np.cumsum(sizes)]), most):
        yield hits_of(*[x.slice(lo, hi - lo) for x in columns], stem)


def summary_hits(ref: Column, a: Column, b: Column, stem: bool) -> Column:
    """``HITS`` of a row's lines; they are stemmed and compared in one step, so a task keeps one Python worker for both."""

    @F.arrow_udf(HITS)
    def hits(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for part in columns:
            yield from hits_in_cuts(part, stem)

    return hits(ref, a, b)


def _in_both(row: np.ndarray, kind: np.ndarray, side: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the size of the multiset intersection of what side 0 holds with that of side 1 and of side 2."""
    kinds = int(kind.max()) + 1 if len(kind) else 1
    keys, counts = zip(*[np.unique(row[side == s] * kinds + kind[side == s], return_counts=True) for s in range(3)])

    def met(s: int) -> np.ndarray:
        both, i, j = np.intersect1d(keys[0], keys[s], assume_unique=True, return_indices=True)
        return np.bincount(both // kinds, weights=np.minimum(counts[0][i], counts[s][j]), minlength=rows).astype(np.int64)

    return met(1), met(2)


def shared_of(ref: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    """``SHARED`` of token lists. Sizes of null lists are null, and so are the words shared with them; they have no word pairs."""
    lists = [x.fill_null([]) if x.null_count else x for x in (ref, a, b)]
    sizes = [x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists]
    row = np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
    side = np.repeat(np.arange(3), [n.sum() for n in sizes])
    coded = pa.concat_arrays([x.flatten().cast(pa.string()) for x in lists]).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    near = (row[1:] == row[:-1]) & (side[1:] == side[:-1])
    _, pair = np.unique((code[:-1] * max(1, len(coded.dictionary)) + code[1:])[near], return_inverse=True)
    words, pairs = _in_both(row, code, side, len(ref)), _in_both(row[:-1][near], pair, side[:-1][near], len(ref))
    gone = [x.is_null().to_numpy(zero_copy_only=False) for x in (ref, a, b)]
    columns = [*zip(sizes, gone), *[(x, gone[0] | g) for x, g in zip(words, gone[1:])], *[(x, None) for x in pairs]]
    return pa.StructArray.from_arrays([pa.array(x, pa.int64(), mask=g) for x, g in columns], [f.name for f in SHARED])


def shared_in_cuts(columns: tuple[pa.Array, ...], most: int = CUT_TOKENS) -> Iterator[pa.Array]:
    """The same for slices of rows that hold a bounded number of tokens."""
    sizes = sum(pc.fill_null(x.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in columns)
    for lo, hi in ranges(np.concatenate([[0], np.cumsum(sizes)]), most):
        yield shared_of(*[x.slice(lo, hi - lo) for x in columns])


@F.arrow_udf(SHARED)
def shared_tokens(columns: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """``SHARED`` of a reference and two summaries, given as token lists; linear in their tokens but for a sort."""
    for part in columns:
        yield from shared_in_cuts(part)


def _rest_by_bits(t: Tokens) -> np.ndarray:
    """For each sentence of at most 64 tokens the LCS with the other sentences of its document in order, 0 for longer ones.

    Only the places of a sentence's own words are visited. The k-th places of all sentences are taken in at once: a row of
    the dynamic program is one 64-bit number, whose carry out of the sentence is dropped.
    """
    out = np.zeros(len(t.n_sent), np.int64)
    kinds = max(1, len(t.words))
    word = t.doc[t.sent_of] * kinds + t.code if len(t.code) else t.code
    key, first = np.unique(t.sent_of * kinds + t.code, return_index=True)
    # the bits of a word's places in its sentence
    starts = np.cumsum(t.n_sent) - t.n_sent
    short = t.n_sent[t.sent_of] <= 64
    at = np.searchsorted(key, (t.sent_of * kinds + t.code)[short])
    masks = np.zeros(len(key), np.uint64)
    np.bitwise_or.at(masks, at, np.uint64(1) << (np.arange(len(t.code)) - starts[t.sent_of])[short].astype(np.uint64))
    own = t.sent_of[first]
    keep = masks > 0
    own, masks, word_of = own[keep], masks[keep], word[first][keep]
    _, kind, many = np.unique(word, return_inverse=True, return_counts=True)
    hits = np.bincount(own, weights=many[kind[first][keep]], minlength=len(t.n_sent))
    ends = starts + t.n_sent
    # some sentences at a time, so that what is held stays bounded
    for a, b in ranges(np.concatenate([[0], np.cumsum(hits)]), CUT_HITS):
        i, j = np.searchsorted(own, [a, b])
        by_word = np.argsort(word_of[i:j], kind="stable")
        lo, hi = starts[t.first[t.doc[a]]], ends[t.first[t.doc[b - 1] + 1] - 1]
        begin, end = (np.searchsorted(word_of[i:j][by_word], word[lo:hi], side) for side in ("left", "right"))
        n = end - begin
        place = np.repeat(np.arange(lo, hi), n)
        pair = i + by_word[np.arange(len(place)) - np.repeat(np.cumsum(n) - n - begin, n)]
        pair = pair[t.sent_of[place] != own[pair]]
        sent = own[pair] - a
        # places are in order already
        hit = masks[pair[np.argsort(sent.astype(np.uint16) if b - a < 1 << 16 else sent, kind="stable")]]
        many_hits = np.bincount(sent, minlength=b - a)
        begin = np.cumsum(many_hits) - many_hits
        has = np.argsort(-many_hits, kind="stable")[:np.count_nonzero(many_hits)]
        begin, most = begin[has], many_hits[has]
        rows = np.full(len(has), ~np.uint64(0))
        for k, m in enumerate(len(has) - np.searchsorted(most[::-1], np.arange(1, most[0] + 1)) if len(has) else []):
            row = rows[:m]
            both = row & hit[begin[:m] + k]
            rows[:m] = (row + both) | (row - both)
        n = t.n_sent[has + a].astype(np.uint64)
        inside = np.where(n == 64, ~np.uint64(0), (np.uint64(1) << (n % np.uint64(64))) - np.uint64(1))
        out[has + a] = np.bitwise_count(~rows & inside)
    return out


def rest_lengths(t: Tokens) -> np.ndarray:
    """For the sentences of documents, the LCS of each with all the others of its document in order.

    Tokens that a sentence does not contain cannot be on the subsequence, so only the positions of its own
    words are visited. Sentences of over 64 tokens are held in numbers of any length, one at a time.
    """
    out = _rest_by_bits(t)
    code = t.code.tolist() if (t.n_sent > 64).any() else []
    ends = np.concatenate([[0], np.cumsum(t.n_sent)])
    where: dict[int, list[int]] = {}
    of = -1
    for s in np.flatnonzero(t.n_sent > 64).tolist():
        if of != t.doc[s]:
            of, where = t.doc[s], {}
            for p in range(ends[t.first[of]], ends[t.first[of + 1]]):
                where.setdefault(code[p], []).append(p)
        lo, hi = int(ends[s]), int(ends[s + 1])
        hits = sorted((p, w) for w in set(code[lo:hi]) for p in where[w] if not lo <= p < hi)
        out[s] = lcs_length(code[lo:hi], [w for _, w in hits]) if hits else 0
    return out


@F.arrow_udf(LCS)
@by_tokens
def lcs_with_rest(lists: pa.Array) -> pa.Array:
    """For the token lists of a document's sentences, the LCS of each with all the others in order."""
    t = Tokens(lists)
    return t.scored(rest_lengths(t))
