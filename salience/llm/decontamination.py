r"""Benchmark passages in documents, found by Wu-Manber multi-pattern search over words.

A word is a maximal run of bytes other than 00-2F, 3A-60 and 7B-7F, A-Z lower-cased first. The patterns are the windows of
ten consecutive words of each benchmark item; an item of fewer words, but not none, is one pattern. Patterns of a length
share one search:

- *shift table*: a block of two neighbouring words (one for patterns of one word), hashed, tells by how many words the
  search may move on without passing the end of any occurrence; blocks of no pattern give the longest shift;
- *buckets*: where the shift is 0, the hash of the block selects the patterns that end in it, ordered by their own hash;
- *comparison*: the words of a selected pattern are compared byte by byte.

The cursor moves through stretches of many documents at once, so every step is an array operation.

The patterns are sent to the tasks in blocks of at most ``BLOCK_BYTES`` of benchmark text, a size that is checked; a larger
benchmark takes one pass over the documents for each block, and the passes are put together by row digests.

Null and empty texts have no words and no hits. Repeated documents are rows of their own; a null document id stays null.
Items of one id are one item; a null item id counts as an item with an empty id. Only the id and text columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salience.llm.batches import pieces
from salience.llm.graph import stored
from salience.llm.words import Words, column_bytes, mixed, shingled
from salience.session import ship

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Windows of one slice of an item.
SLICE = 4096
#: Word positions that one cursor covers.
STRETCH = 128
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

_CLEAN = np.full(256, 32, np.uint8)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _CLEAN[_low:_high + 1] = np.arange(_low, _high + 1)
_CLEAN[0x41:0x5B] = np.arange(0x61, 0x7B)


def clean_words(column: pa.Array) -> Words:
    """The words of a text column; every other byte counts as a blank."""
    raw, offsets = column_bytes(column)
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(_CLEAN[raw])]
    return Words(pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers))


def _blocks(hashes: np.ndarray, last: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that end at each place of ``last``."""
    own = hashes[last] * _FIRST
    return mixed(own if size == 1 else own + hashes[last - 1] * _SECOND)


@dataclass
class Patterns:
    """The distinct patterns of one length: shift table, buckets, and the text of each."""

    length: int
    block: int
    bits: int
    shifts: np.ndarray       # by the highest bits of a block's hash
    suffixes: np.ndarray     # sorted hashes of the last blocks
    bucket: np.ndarray       # bucket i holds the patterns bucket[i] to bucket[i + 1] - 1
    hashes: np.ndarray       # ascending inside a bucket
    text: bytes
    begin: np.ndarray        # place of each pattern in ``text``
    end: np.ndarray
    item_start: np.ndarray   # pattern i occurs in items[item_start[i]:item_start[i + 1]]
    items: np.ndarray

    @classmethod
    def of(cls, words: Words, first: np.ndarray, item: np.ndarray, length: int) -> "Patterns":
        """From the places of first words, with the number of the item of each."""
        block = min(2, length)
        hashes = shingled(words.hash, length, first)
        order = np.lexsort((item, hashes))
        hashes, first, item = hashes[order], first[order], item[order]
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1])])
        other = new | np.concatenate([[True], item[1:] != item[:-1]])
        at = np.flatnonzero(new)
        items = item[other]
        item_start = np.append(np.searchsorted(np.flatnonzero(other), at), len(items))
        hashes, first = hashes[at], first[at]
        lists = [items[lo:hi] for lo, hi in zip(item_start, item_start[1:])]

        bits = int(min(24, max(12, np.ceil(np.log2(len(first) * length)) + 3)))
        shifts = np.full(1 << bits, length - block + 1, np.uint8)
        for place in range(block, length + 1):  # the later place overwrites: it allows the smaller shift
            shifts[_blocks(words.hash, first + place - 1, block) >> np.uint64(64 - bits)] = length - place

        suffix = _blocks(words.hash, first + length - 1, block)
        order = np.lexsort((hashes, suffix))
        suffixes, starts = np.unique(suffix[order], return_index=True)
        lists = [lists[i] for i in order]
        last = words.start[first[order] + length - 1]
        ends = np.flatnonzero(np.append(words.raw, np.uint8(32)) == 32)
        return cls(length, block, bits, shifts, suffixes, np.append(starts, len(order)), hashes[order], words.raw.tobytes(),
                   words.start[first[order]], np.minimum(ends[np.searchsorted(ends, last)], words.offsets[np.searchsorted(words.offsets, last, "right")]),
                   np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64), np.concatenate(lists))

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of every occurrence."""
        low, high = words.bounds[:-1] + self.length - 1, words.bounds[1:]
        some = low < high
        low, high = low[some], high[some]
        parts = -(-(high - low) // STRETCH)
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        cursor = np.repeat(low, parts) + number * STRETCH
        stop = np.minimum(cursor + STRETCH, np.repeat(high, parts))
        ends, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        while len(cursor):
            key = _blocks(words.hash, cursor, self.block)
            shift = self.shifts[key >> np.uint64(64 - self.bits)]
            possible = shift == 0
            ends.append(cursor[possible]), keys.append(key[possible])
            cursor = cursor + np.maximum(shift, 1)
            left = cursor < stop
            cursor, stop = cursor[left], stop[left]
        end, key = np.concatenate(ends), np.concatenate(keys)
        at = np.minimum(np.searchsorted(self.suffixes, key), len(self.suffixes) - 1)
        known = self.suffixes[at] == key
        first, at = end[known] - self.length + 1, at[known]
        own = shingled(words.hash, self.length, first)
        lo, hi = self.bucket[at], self.bucket[at + 1]
        top = hi
        while (lo < hi).any():  # binary search inside every bucket at once
            middle = (lo + hi) // 2
            right = (lo < hi) & (self.hashes[np.minimum(middle, len(self.hashes) - 1)] < own)
            lo, hi = np.where(right, middle + 1, lo), np.where(right | (lo >= hi), hi, middle)
        same = (lo < top) & (self.hashes[np.minimum(lo, len(self.hashes) - 1)] == own)
        first, pattern = first[same], lo[same]
        equal = np.fromiter((self._equal(words, i, p) for i, p in zip(first.tolist(), pattern.tolist())), bool, len(first))
        return first[equal], pattern[equal]

    def _equal(self, words: Words, first: int, pattern: int) -> bool:
        beyond = first + self.length
        stop = words.start[beyond] if beyond < len(words.start) else len(words.raw)
        found = words.raw[words.start[first]:stop].tobytes().split()[:self.length]
        return b" ".join(found) == self.text[self.begin[pattern]:self.end[pattern]]


def patterns_of(rows: pa.Table, window: int = WINDOW) -> tuple[list[Patterns], np.ndarray]:
    """The patterns of slices (item, words), by length, and the ids that their item numbers stand for."""
    ids, item = np.unique(np.array(rows["item"].to_pylist(), dtype=object), return_inverse=True)
    words = clean_words(rows["words"])
    n = np.diff(words.bounds)
    length = np.minimum(n, window)
    out = []
    for size in np.unique(length[length > 0]).tolist():
        some = np.flatnonzero(length == size)
        each = n[some] - size + 1
        first = np.repeat(words.bounds[some], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        out.append(Patterns.of(words, first, np.repeat(item[some], each), size))
    return out, ids


def found_in(column: pa.Array, patterns: list[Patterns], ids: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array]:
    """Per text: its words, first and end of the disjoint stretches of hit words, sorted ids of the items found."""
    words = clean_words(column)
    marks = np.zeros(len(words.start) + 1, np.int64)
    rows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in patterns:
        first, pattern = p.find(words)
        np.add.at(marks, first, 1)
        np.add.at(marks, first + p.length, -1)
        row = np.searchsorted(words.bounds, first, "right") - 1
        seen = np.unique(np.column_stack([row, pattern]), axis=0)
        each = np.diff(p.item_start)[seen[:, 1]]
        rows.append(np.repeat(seen[:, 0], each))
        items.append(p.items[np.repeat(p.item_start[seen[:, 1]], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)])
    hit = np.cumsum(marks)[:-1] > 0
    opens, closes = hit.copy(), hit.copy()
    opens[1:] &= ~hit[:-1]
    closes[:-1] &= ~hit[1:]
    edge = words.bounds[1:-1]
    edge = edge[(edge > 0) & (edge < len(hit))]
    opens[edge], closes[edge - 1] = hit[edge], hit[edge - 1]
    opens, closes = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    row = np.searchsorted(words.bounds, opens, "right") - 1
    offsets = pa.array(np.searchsorted(row, np.arange(len(words.bounds))).astype(np.int32))
    n = len(words.bounds) - 1
    pairs = np.unique(np.column_stack([np.concatenate(rows), np.concatenate(items)]), axis=0)
    item_offsets = pa.array(np.searchsorted(pairs[:, 0], np.arange(n + 1)).astype(np.int32))
    names = pa.array(ids[pairs[:, 1]].tolist(), pa.string())  # ids are sorted, so each list is
    base = words.bounds[row]
    return (np.diff(words.bounds), pa.ListArray.from_arrays(offsets, pa.array(opens - base)),
            pa.ListArray.from_arrays(offsets, pa.array(closes - base)), pa.ListArray.from_arrays(item_offsets, names))


def _slices(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, words): the cleaned words of items, long ones in slices that share ``window - 1`` words with the next."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in pieces(batch):
                words = clean_words(part.column("text"))
                items, texts = [], []
                for i, item in enumerate(part.column("item").to_pylist()):
                    n = int(words.bounds[i + 1] - words.bounds[i])
                    for at in range(0, max(1, n - window + 1) if n else 0, SLICE):
                        lo = int(words.bounds[i]) + at
                        hi = int(min(words.bounds[i + 1], lo + SLICE + window - 1))
                        stop = words.start[hi] if hi < len(words.start) else len(words.raw)
                        items.append(item)
                        texts.append(b" ".join(words.raw[words.start[lo]:stop].tobytes().split()[:hi - lo]))
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.binary())], names=["item", "words"])

    return rows.mapInArrow(run, "item string, words binary")


def _one_pass(docs: DataFrame, id_col: str, text_col: str, rows: pa.Table, window: int) -> DataFrame:
    """id, digest, n_words, starts, ends, items of every document against one block of patterns."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(patterns_of(rows, window))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        patterns, ids = shared.value
        for batch in batches:
            for part in pieces(batch):
                n, starts, ends, items = found_in(part.column("text"), patterns, ids)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n), starts, ends, items], names=["id", "n_words", "starts", "ends", "items"])

    return texts.mapInArrow(run, f"id {kind}, n_words long, starts array<long>, ends array<long>, items array<string>")


def _merged(parts: list[DataFrame]) -> DataFrame:
    """Results of the passes put together, a row per document row; rows of equal id and text have equal results."""
    hits = parts[0]
    for more in parts[1:]:
        hits = hits.unionByName(more)
    hits = hits.filter(F.size("starts") > 0).groupBy("id", "digest").agg(
        F.array_sort(F.flatten(F.collect_set(F.arrays_zip("starts", "ends")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def unite(done, s):
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["starts"].alias("starts"), F.greatest(last["ends"], s["ends"]).alias("ends"))
        meets = F.coalesce(s["starts"] <= last["ends"], F.lit(False))
        return F.when(meets, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(s)))

    hits = hits.withColumn("spans", F.aggregate("spans", F.slice("spans", 1, 0), unite))
    keyed = parts[0].select("id", "digest", "n_words")
    found = keyed.alias("k").join(hits.alias("h"), F.col("k.id").eqNullSafe(F.col("h.id")) & (F.col("k.digest") == F.col("h.digest")), "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return found.select("k.id", "n_words", none(F.transform("spans", lambda s: s["starts"]), "array<bigint>").alias("starts"),
                        none(F.transform("spans", lambda s: s["ends"]), "array<bigint>").alias("ends"), none(F.col("items"), "array<string>").alias("items"))


def _dealt(slices: DataFrame, blocks: int) -> DataFrame:
    return slices.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))


def _fits(dealt: DataFrame) -> bool:
    """Whether no block but one of a single slice has more than twice the size aimed at."""
    sizes = dealt.groupBy("block").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    return sizes.filter((F.col("bytes") > 2 * BLOCK_BYTES) & (F.col("n") > 1)).isEmpty()


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id_col, n_words, spans (disjoint stretches ``first`` to ``end - 1`` of hit words) and items, a row per document."""
    ship(docs.sparkSession)
    slices = stored(_slices(benchmark, item_col, item_text_col, window).distinct(), "items")
    slices = slices.withColumn("bytes", F.length("words") + F.length("item"))
    blocks = max(1, -(-(slices.agg(F.sum("bytes")).first()[0] or 0) // BLOCK_BYTES))
    if blocks == 1:
        found = _one_pass(docs, id_col, text_col, slices.select("item", "words").toArrow(), window)
    else:
        while not _fits(_dealt(slices, blocks)):
            blocks *= 2
        digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
        keyed = docs.select(F.struct(F.col(id_col).alias("id"), digest.alias("digest")).alias("id"), F.col(text_col).alias("text"))
        passes = [_one_pass(keyed, "id", "text", _dealt(slices, blocks).filter(F.col("block") == i).select("item", "words").toArrow(), window)
                  for i in range(blocks)]
        found = _merged([stored(p.select("id.id", "id.digest", "n_words", "starts", "ends", "items"), "pass") for p in passes])
    return found.select(F.col("id").alias(id_col), "n_words", F.zip_with("starts", "ends", lambda a, b: F.struct(a.alias("first"), b.alias("end"))).alias("spans"), "items")
