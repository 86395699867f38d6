"""Quality of documents by voting among their nearest labelled documents in a latent-semantic space.

A document's terms are its words, the shapes of its words (runs of capitals, small letters, digits and other signs) and
how much it repeats itself, in ``TERMS`` hashed places. Inverse document frequencies and the ``LATENT`` leading singular
directions are fitted on at most ``LABELLED`` labelled rows, drawn by a hash of the id; that bound is a parameter. Their
unit vectors with their labels are broadcast, ``LABELLED * LATENT`` numbers however large the corpus. Every document is
compared with all of them in blocks, and its ``NEAREST`` most similar ones vote with their similarity as weight.

Null and empty texts have no vector and score as the mean label; without any usable label everything scores 1.0. Rows
are independent, so ties, repeated rows and repeated ids need no rule; a label whose id has several documents counts for
each of them. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salience.llm.batches import tidy
from salience.llm.words import as_bytes
from salience.session import ship

WORDS, SHAPES, HABITS = 1024, 512, 48
TERMS = WORDS + SHAPES + HABITS
LATENT = 64
LABELLED = 4096
NEAREST = 25
BLOCK = 512
#: Bytes of the words a worker remembers, with what an entry of its table takes.
REMEMBERED, ENTRY = 32 << 20, 160

_SHAPE = [(re.compile(rb"[A-Z]+"), b"X"), (re.compile(rb"(?:[a-z]|[\x80-\xff])+"), b"x"), (re.compile(rb"[0-9]+"), b"9"),
          (re.compile(rb"([^Xx9])\1+"), rb"\1\1")]


class Model(NamedTuple):
    idf: np.ndarray  # one per term
    directions: np.ndarray  # terms by latent
    vectors: np.ndarray  # labelled rows by latent, of length 1 (or 0)
    labels: np.ndarray
    prior: float


class _Terms(dict):
    """The two term places of a word, as one number. ``size`` are the bytes of the words."""

    size = 0

    def clear(self) -> None:
        super().clear()
        self.size = 0

    def __missing__(self, word: bytes) -> int:
        self.size += len(word) + ENTRY
        shape = word
        for pattern, sign in _SHAPE:
            shape = pattern.sub(sign, shape)
        value = self[word] = (xxhash.xxh3_64_intdigest(shape) % SHAPES << 16) | xxhash.xxh3_64_intdigest(word.lower()) % WORDS
        return value


_terms = _Terms()


def term_vector(text: bytes | None) -> np.ndarray:
    """Weights before inverse document frequency; each of the three kinds of terms has length 1."""
    out = np.zeros(TERMS, np.float32)
    words = (text or b"").split()
    if not words:
        return out
    if _terms.size > REMEMBERED:
        _terms.clear()
    codes = np.fromiter(map(_terms.__getitem__, words), np.int64, len(words))
    out[:WORDS] = np.sqrt(np.bincount(codes & 0xFFFF, minlength=WORDS))
    out[WORDS:WORDS + SHAPES] = np.sqrt(np.bincount(codes >> 16, minlength=SHAPES))
    out[:WORDS] /= np.linalg.norm(out[:WORDS])
    out[WORDS:WORDS + SHAPES] /= np.linalg.norm(out[WORDS:WORDS + SHAPES])
    habits = WORDS + SHAPES
    stutter = float(np.mean(codes[1:] == codes[:-1])) if len(codes) > 1 else 0.0
    fresh = len(np.unique(codes)) / len(codes) ** 0.8
    for place, share in ((0, stutter), (16, fresh / 4), (32, np.log2(len(words) + 1) / 20)):
        out[habits + place + min(15, int(share * 16))] = 0.58
    return out


def unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norms == 0, 1, norms)


def fit_vectors(x: np.ndarray, labels: np.ndarray) -> Model:
    seen = (x > 0).sum(axis=0)
    idf = np.log((1 + len(x)) / (1 + seen)).astype(np.float32) + 1
    # shapes and habits mark documents of any kind, so their commonness does not make them weaker
    idf[WORDS:] = idf[:WORDS].mean() if len(x) else 1
    weighted = x * idf
    _, vectors = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
    directions = np.ascontiguousarray(vectors[:, ::-1][:, :LATENT]).astype(np.float32)
    return Model(idf, directions, unit(weighted @ directions).astype(np.float32), labels.astype(np.float32), float(labels.mean()) if len(labels) else 1.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED) -> Model:
    """``labels`` has id_col and label_col (0 or 1); rows with nulls are left out."""
    ship(docs.sparkSession)
    draw = F.xxhash64(F.col("id"), F.lit(5))
    wanted = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).dropna()
    wanted = wanted.orderBy(draw, "label").limit(labelled)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(wanted), "id")

    def vectors(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = [term_vector(t) for t in as_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "label", "v"])
        _terms.clear()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = texts.mapInArrow(vectors, f"id {kind}, label double, v binary").orderBy(draw, "label", F.xxhash64("v")).limit(labelled).collect()
    x = np.array([np.frombuffer(r["v"], np.float32) for r in rows], np.float32).reshape(-1, TERMS)
    return fit_vectors(x, np.array([r["label"] for r in rows]))


def votes(model: Model, x: np.ndarray) -> np.ndarray:
    """Scores of term vectors, by exact cosine products with all labelled vectors."""
    scores = np.full(len(x), model.prior)
    some = np.flatnonzero(x.any(axis=1))
    if not len(model.vectors) or not len(some):
        return scores
    cosines = unit((x[some] * model.idf) @ model.directions) @ model.vectors.T
    k = min(NEAREST, cosines.shape[1])
    near = np.argpartition(cosines, -k, axis=1)[:, -k:]
    weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** 4 + 1e-9
    scores[some] = (weight * model.labels[near]).sum(axis=1) / weight.sum(axis=1)
    return np.clip(scores, 0.0, 1.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col and score, one row per input row; narrow, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), score_of(docs, model, F.col(text_col)).alias("score"))
    assert chosen.schema["id"].dataType.simpleString() == kind
    return chosen.withColumnRenamed("id", id_col)


def score_of(docs: DataFrame, model: Model, text: Column) -> Column:
    """The score as a column of ``docs``."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    @F.arrow_udf("double")
    def of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Model(*shared.value)
        for column in columns:
            parts = [votes(known, np.array([term_vector(t) for t in as_bytes(column.slice(at, BLOCK))], np.float32).reshape(-1, TERMS))
                     for at in range(0, len(column), BLOCK)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
        _terms.clear()
        tidy()

    return of(text.cast("string"))
