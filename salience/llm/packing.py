"""Packing documents into token sequences along a space-filling curve.

A document's byte triples are hashed into ``BUCKETS`` counts, the unit vector of the counts is projected to ``DIMS`` fixed
directions, and the Hilbert key of the projection orders the documents: one range shuffle of the texts puts neighbours on
the curve next to each other. Each range is then tokenized in order and cut every ``length`` tokens, so documents of one
sequence resemble each other and only the end of a range is left over. That end is cut into powers of two, which need no
padding; so there is none at all.

A document is its token ids and ``end_id``; null text is an empty one, one piece of one token. Equal keys are split
between ranges by id and text hash, so no number of equal documents makes a range hot. Long documents run over as many
sequences as they need. Repeated rows are packed as often as they occur. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salience.llm.batches import pieces as slices
from salience.llm.batches import tidy
from salience.llm.hilbert import directions, even, hilbert_keys
from salience.llm.words import as_bytes
from salience.session import ship

BUCKETS = 256
DIMS = 4
BITS = 12
LENGTH = 4096
#: Texts worked on at once.
ROWS = 500
#: Distinct words, and distinct parts of words, whose ids a worker remembers.
REMEMBERED = 400_000

_PROJECTION = directions(BUCKETS, DIMS, 10)
_tokens: dict[str, "_WordIds"] = {}


#: Letters whose small form is one letter and which no normalization changes, then other printable ASCII signs but digits
#: and the apostrophe, which may start a contraction.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")
_PROBES = ["word", "Word,", "ÉTÉ.", "mañana", "straße!!", "x|", "thhaen.***", "aß_", "Über---", "a", "öÖ%%%"]


def _byte_signs() -> dict[int, int]:
    """The sign that stands for each byte in byte-level vocabularies: itself if it prints, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: 256 + i for i, b in enumerate(others)}


class _WordIds:
    """Token ids of words as little-endian bytes.

    The tokenizer drops white space and no token crosses it, so a text's ids are those of its words in a row. A word of
    plain letters with plain marks behind it goes straight to the tokenizer's model, letters and marks apart, if that
    gives what the whole tokenizer gives for some probes; other words go through the whole tokenizer. A full table of words or
    parts starts anew, and both are dropped when a task ends.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.signs = _byte_signs()
        self.now: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.straight = all(self._straight(p) == self._whole(p) for p in _PROBES)

    def _whole(self, word: str) -> bytes:
        return np.asarray(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            tokens = self.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.signs))
            ids = self.parts[part] = np.array([t.id for t in tokens], "<u4").tobytes()
        return ids

    def _straight(self, word: str) -> bytes | None:
        plain = _PLAIN.match(word)
        if plain is None:
            return None
        ids = self._part(plain[1].lower())
        return ids + self._part(plain[2]) if plain[2] else ids

    def learn(self, words: set[bytes]) -> None:
        if len(self.now) > REMEMBERED:
            self.now = {}
        if len(self.parts) > REMEMBERED:
            self.parts = {}
        now = self.now
        for word in words:
            if word not in now:
                text = word.decode("utf-8", "replace")
                ids = self._straight(text) if self.straight else None
                now[word] = self._whole(text) if ids is None else ids

    def forget(self) -> None:
        self.now, self.parts = {}, {}


def ids_of(texts: list[bytes | None], path: str, end_id: int) -> list[bytes]:
    """The token ids of each text with ``end_id`` behind them."""
    table = _tokens.get(path)
    if table is None:
        table = _tokens[path] = _WordIds(path)
    words = [(t or b"").split() for t in texts]
    table.learn(set().union(*words))
    end, get = end_id.to_bytes(4, "little"), table.now.__getitem__
    return [b"".join(map(get, ws)) + end for ws in words]


def curve_keys(texts: list[bytes | None]) -> np.ndarray:
    counts = np.zeros((len(texts), BUCKETS))
    for i, text in enumerate(texts):
        if text and len(text) > 2:
            signs = np.frombuffer(text, np.uint8)
            counts[i] = np.bincount(signs[2:] * np.uint8(101) + signs[1:-1] * np.uint8(37) + signs[:-2], minlength=BUCKETS)
    norms = np.linalg.norm(counts, axis=1, keepdims=True)
    units = counts / np.where(norms == 0, 1, norms)
    points = (units - 1 / np.sqrt(BUCKETS)) @ _PROJECTION * np.sqrt(BUCKETS)
    return hilbert_keys((even(points) * (1 << BITS)).astype(np.int64), BITS)


def curve_key(text: Column) -> Column:
    @F.arrow_udf("long")
    def key(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tidy()
        for column in columns:
            parts = [curve_keys(as_bytes(column.slice(at, ROWS))) for at in range(0, len(column), ROWS)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())

    return key(text)


class _Cutter:
    """Fills sequences with document pieces and hands out the pieces of full ones."""

    def __init__(self, partition: int, length: int):
        self.next = partition << 33
        self.length = length
        self.open: list[tuple] = []  # (doc_id, first id, bytes, doc_tokens)
        self.filled = 0

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        tokens, done = len(ids) // 4, 0
        while done < tokens:
            n = min(tokens - done, self.length - self.filled)
            self.open.append((doc_id, done, ids[4 * done:4 * (done + n)], tokens))
            self.filled += n
            done += n
            if self.filled == self.length:
                yield from self.close(self.length)

    def close(self, length: int) -> Iterator[tuple]:
        """The first ``length`` open tokens as one sequence."""
        offset, left = 0, []
        for doc_id, start, ids, tokens in self.open:
            n = min(len(ids) // 4, length - offset)
            if n:
                yield doc_id, start, n, zlib.crc32(ids[:4 * n]), tokens, self.next, offset
            if 4 * n < len(ids):
                left.append((doc_id, start + n, ids[4 * n:], tokens))
            offset += n
        self.open, self.filled, self.next = left, self.filled - length, self.next + 1

    def end(self) -> Iterator[tuple]:
        while self.filled:
            yield from self.close(1 << (self.filled.bit_length() - 1))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``length`` must be a power of two. ``tokenizer`` names a file that every worker has.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    along = rows.withColumn("key", curve_key(F.col("text"))).withColumn("tie", F.xxhash64("text"))
    along = along.repartitionByRange("key", "doc_id", "tie").sortWithinPartitions("key", "doc_id", "tie").select("doc_id", "text")

    def cut(batches):
        cutter = _Cutter(TaskContext.get().partitionId(), length)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        id_type = pa.int64()

        def batch_of(pieces):
            columns = list(zip(*pieces))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=names)

        pieces: list[tuple] = []
        tidy()
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for part in slices(batch, most=1 << 21, rows=ROWS):
                ids = ids_of(as_bytes(part.column("text")), tokenizer, end_id)
                for doc_id, own in zip(part.column("doc_id").to_pylist(), ids):
                    pieces.extend(cutter.add(doc_id, own))
                    if len(pieces) > 20_000:
                        yield batch_of(pieces)
                        pieces = []
        pieces.extend(cutter.end())
        if pieces:
            yield batch_of(pieces)
        if tokenizer in _tokens:
            _tokens[tokenizer].forget()
        tidy()

    return along.mapInArrow(
        cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
