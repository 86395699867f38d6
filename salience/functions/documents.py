"""Scores of each sentence of a document, from the token lists of its sentences; Arrow UDFs, one row in, one row out.

Everything that a sentence is compared with is in the row of its document, so none of this shuffles. A batch is counted as
flat arrays: tokens are numbered once, and a count is one sort over (sentence, token) or (document, token) numbers. A
sentence without tokens scores 0. Batches are cut by their tokens, so a task's memory follows neither their rows nor the
length of texts, as long as one document fits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_BUCKETS = 64
#: Tokens, or bytes of text, that are worked on at once.
CUT_TOKENS = 1 << 18
CUT_BYTES = 1 << 20
_LONGS = T.ArrayType(T.LongType())


def _scores(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("n_doc", T.LongType()), T.StructField("n_sent", _LONGS), T.StructField("scores", T.ArrayType(kind))])


LCS = _scores(T.LongType())
#: One element per distinct word of a sentence, and one without a word for a sentence that has none.
WORD = T.StructType([T.StructField("w", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n_doc", "sid", "n_sent", "overlap", "c", "c_doc")]])
#: One element per sentence; words are listed that no table of frequent words has and whose corpus counts are still needed.
SENTENCE = T.StructType([*[T.StructField(c, T.LongType()) for c in ("sid", "n_doc", "n_sent", "overlap")], *[T.StructField(c, T.DoubleType()) for c in ("near_bits", "far_bits")],
                         T.StructField("rare", T.ArrayType(T.StructType([T.StructField("w", T.StringType()), T.StructField("c", T.LongType()), T.StructField("c_doc", T.LongType())])))])


def ranges(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``most`` each, but one row at least; ``ends`` are running sums that begin with the sum before the first row."""
    at, n = 0, len(ends) - 1
    while at < n:
        end = min(max(int(np.searchsorted(ends, ends[at] + most, "right")) - 1, at + 1), n)
        yield at, end
        at = end


def token_cuts(column: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """A column of sentence lists in slices of bounded tokens."""
    column = column.fill_null([]) if column.null_count else column
    ends = column.values.offsets.to_numpy()[column.offsets.to_numpy()] if len(column) else np.zeros(1, np.int64)
    for lo, hi in ranges(ends, most or CUT_TOKENS):
        yield column.slice(lo, hi - lo)


def by_tokens(score: Callable[[pa.Array], pa.Array]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """The function on batches as one that works on slices of bounded tokens."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            for part in token_cuts(column):
                yield score(part)

    return run


@lru_cache(maxsize=200_000)
def hash_bucket(word: str, buckets: int) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % buckets


class Tokens:
    """The tokens of a column of sentence lists as numbers, with the sentence and document of each."""

    def __init__(self, column: pa.Array):
        column = column.fill_null([]) if column.null_count else column
        sents = column.flatten()
        sents = sents.fill_null([]) if sents.null_count else sents
        coded = sents.flatten().dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = coded.dictionary
        self.n_sent = sents.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        #: first sentence of each document, with the end behind
        self.first = np.concatenate([[0], np.cumsum(lengths)])
        self.doc = np.repeat(np.arange(len(lengths)), lengths)
        self.sent_of = np.repeat(np.arange(len(self.n_sent)), self.n_sent)
        self.n_doc = np.bincount(self.doc, weights=self.n_sent, minlength=len(lengths)).astype(np.int64)

    def counted(self, code: np.ndarray, sent: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sentence, number, count in the sentence and count in the document of every distinct pair, by sentence."""
        key, c = np.unique(sent * kinds + code, return_counts=True)
        sent, code = key // kinds, key % kinds
        _, place = np.unique(self.doc[sent] * kinds + code, return_inverse=True)
        return sent, code, c, np.bincount(place, weights=c).astype(np.int64)[place]

    def lists(self, values: np.ndarray) -> pa.Array:
        """One value per sentence as a list per document."""
        return pa.ListArray.from_arrays(pa.array(self.first.astype(np.int32)), pa.array(values))

    def scored(self, values: np.ndarray) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(self.n_doc), self.lists(self.n_sent), self.lists(values)], ["n_doc", "n_sent", "scores"])

    def per_sentence(self, sent: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(sent, weights=values, minlength=len(self.n_sent))


def shared_words(t: Tokens) -> np.ndarray:
    """Per sentence the multiset overlap of its words with those of the other sentences."""
    sent, _, c, c_doc = t.counted(t.code, t.sent_of, max(1, len(t.words)))
    return t.per_sentence(sent, np.minimum(c, c_doc - c)).astype(np.int64)


def shared_pairs(t: Tokens) -> np.ndarray:
    """The same for pairs of neighbouring words, where taking a sentence out breaks the pairs at its borders and joins its
    neighbours."""
    n = max(1, len(t.words))
    doc = t.doc[t.sent_of]
    near = doc[1:] == doc[:-1]
    pair = (t.code[:-1] * n + t.code[1:])[near]
    sent, follows = t.sent_of[:-1][near], t.sent_of[1:][near]
    kinds, pair = np.unique(pair, return_inverse=True)
    total_key, total = np.unique(doc[:-1][near] * max(1, len(kinds)) + pair, return_counts=True)
    inside = sent == follows
    key, c = np.unique(sent[inside] * max(1, len(kinds)) + pair[inside], return_counts=True)
    own, code = key // max(1, len(kinds)), key % max(1, len(kinds))
    lost = np.zeros(len(own), np.int64)
    # pairs at the borders of each sentence that has tokens, and the pair its removal makes; -1 where there is none
    ends = np.cumsum(t.n_sent)
    filled = np.flatnonzero(t.n_sent)
    head, tail = t.code[(ends - t.n_sent)[filled]], t.code[ends[filled] - 1]
    same = t.doc[filled[1:]] == t.doc[filled[:-1]]
    none = np.full(1, -1)
    before = np.concatenate([none, np.where(same, tail[:-1], -1)]) if len(filled) else np.zeros(0, np.int64)
    after = np.concatenate([np.where(same, head[1:], -1), none]) if len(filled) else np.zeros(0, np.int64)
    at = np.searchsorted(filled, own)
    for a, b, by in ((before, head, 1), (tail, after, 1), (before, after, -1)):
        border = np.where((a >= 0) & (b >= 0), a * n + b, -1)
        lost += by * (border[at] == kinds[code]) if len(own) else 0
    if not len(own):
        return np.zeros(len(t.n_sent), np.int64)
    whole = total[np.searchsorted(total_key, t.doc[own] * len(kinds) + code)]
    return t.per_sentence(own, np.minimum(c, np.maximum(0, whole - c - lost))).astype(np.int64)


def hashed_cosines(t: Tokens, buckets: int) -> np.ndarray:
    """Cosine of the hashed word counts of a sentence and of the other sentences."""
    bucket = np.array([hash_bucket(w, buckets) for w in t.words.to_pylist()] or [0], np.int64)
    sent, code, c, total = t.counted(bucket[t.code] if len(t.code) else t.code, t.sent_of, buckets)
    _, place = np.unique(t.doc[sent] * buckets + code, return_index=True)
    whole = np.bincount(t.doc[sent[place]], weights=total[place].astype(float) ** 2, minlength=len(t.n_doc))
    c, total = c.astype(float), total.astype(float)
    dot, size = t.per_sentence(sent, c * (total - c)), t.per_sentence(sent, c * c)
    rest = (whole[t.doc] if len(t.doc) else np.zeros(0)) - t.per_sentence(sent, total ** 2 - (total - c) ** 2)
    some = (size > 0) & (rest > 0)
    return np.divide(dot, np.sqrt(np.where(some, size * rest, 1.0)), out=np.zeros(len(dot)), where=some)


@F.arrow_udf(_scores(T.LongType()))
@by_tokens
def _words(column: pa.Array) -> pa.Array:
    t = Tokens(column)
    return t.scored(shared_words(t))


@F.arrow_udf(_scores(T.LongType()))
@by_tokens
def _pairs(column: pa.Array) -> pa.Array:
    t = Tokens(column)
    return t.scored(shared_pairs(t))


@F.arrow_udf(T.ArrayType(WORD))
@by_tokens
def _counts(column: pa.Array) -> pa.Array:
    t = Tokens(column)
    sent, code, c, c_doc = t.counted(t.code, t.sent_of, max(1, len(t.words)))
    overlap = t.per_sentence(sent, np.minimum(c, c_doc - c)).astype(np.int64)
    blank = np.flatnonzero(t.n_sent == 0)
    at = np.searchsorted(sent, blank)
    sent, code, c, c_doc = (np.insert(x, at, y) for x, y in ((sent, blank), (code, -1), (c, 0), (c_doc, 0)))
    words = t.words.take(pa.array(code, mask=code < 0))
    doc = t.doc[sent] if len(sent) else sent
    numbers = [t.n_doc[doc], sent - t.first[doc], t.n_sent[sent], overlap[sent], c, c_doc] if len(sent) else [np.zeros(0, np.int64)] * 6
    rows = pa.StructArray.from_arrays([words, *[pa.array(x.astype(np.int64)) for x in numbers]], [f.name for f in WORD])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(sent, t.first).astype(np.int32)), rows)


def word_overlaps(lists: Column | str) -> Column:
    """Struct of the document's tokens ``n_doc`` and, per sentence, ``n_sent`` and ``scores``."""
    return _words(lists)


def pair_overlaps(lists: Column | str) -> Column:
    return _pairs(lists)


def word_counts(lists: Column | str) -> Column:
    """The distinct words of each sentence, with their counts in sentence and document, as one flat list of ``WORD``."""
    return _counts(lists)


def known_bits(t: Tokens, words: pa.Array, c_all: np.ndarray, size: float, mu: float, whole: bool) -> pa.Array:
    """``SENTENCE`` lists: the bits by which the rest of a document makes the given words likelier, summed over a sentence, and
    its other words with their counts.

    A word that no other sentence of its document has loses the same bits whatever the corpus holds of it: the rest is
    smoothed to ``mu * p0 / (rest + mu)``, and ``p0`` cancels out. With ``whole``, when the corpus has every word, such words
    are summed here and not listed.
    """
    sent, code, c, c_doc = t.counted(t.code, t.sent_of, max(1, len(t.words)))
    overlap = t.per_sentence(sent, np.minimum(c, c_doc - c)).astype(np.int64)
    found = pc.fill_null(pc.index_in(t.words, value_set=words), -1).to_numpy(zero_copy_only=False)
    place = found[code] if len(code) else code
    near = place >= 0
    own, n = sent[near], c[near]
    bits = np.zeros(len(t.n_sent))
    if len(own):
        p0 = (c_all[place[near]] + 1.0) / size
        ratio = ((c_doc[near] - n) + mu * p0) / (t.n_doc[t.doc[own]] - t.n_sent[own] + mu) / p0
        bits = t.per_sentence(own, n * np.log2(ratio, out=np.zeros(len(ratio)), where=ratio > 0))
    far = ~near
    lone_bits = np.zeros(len(t.n_sent))
    if whole:
        lone = far & (c_doc == c)
        far &= ~lone
        if mu > 0 and lone.any():
            own = sent[lone]
            lone_bits = t.per_sentence(own, c[lone] * np.log2(mu / (t.n_doc[t.doc[own]] - t.n_sent[own] + mu)))
    rare = pa.StructArray.from_arrays([t.words.take(pa.array(code[far])).cast(pa.string()), pa.array(c[far].astype(np.int64)), pa.array(c_doc[far])], ["w", "c", "c_doc"])
    ends = np.searchsorted(sent[far], np.arange(len(t.n_sent) + 1)).astype(np.int32)
    numbers = [np.arange(len(t.doc)) - t.first[t.doc], t.n_doc[t.doc], t.n_sent, overlap] if len(t.doc) else [np.zeros(0, np.int64)] * 4
    rows = pa.StructArray.from_arrays([*[pa.array(x.astype(np.int64)) for x in numbers], pa.array(bits), pa.array(lone_bits), pa.ListArray.from_arrays(pa.array(ends), rare)], [f.name for f in SENTENCE])
    return pa.ListArray.from_arrays(pa.array(t.first.astype(np.int32)), rows)


def sentence_bits(lists: Column | str, known: Broadcast, size: float, mu: float, whole: bool) -> Column:
    """Per document its sentences as ``SENTENCE``; ``known`` has the frequent words of the corpus and their counts, ``size`` is
    the corpus in tokens and kinds, ``whole`` says that it has every word of the documents."""

    @F.arrow_udf(T.ArrayType(SENTENCE))
    def bits(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, c_all = known.value
        for column in columns:
            for part in token_cuts(column):
                yield known_bits(Tokens(part), words, c_all, size, mu, whole)

    return bits(lists)


def context_cosines(lists: Column | str, buckets: int = HASH_BUCKETS) -> Column:
    @F.arrow_udf(_scores(T.DoubleType()))
    @by_tokens
    def cosines(column: pa.Array) -> pa.Array:
        t = Tokens(column)
        return t.scored(hashed_cosines(t, buckets))

    return cosines(lists)
