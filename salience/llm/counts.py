"""Token counts under a unigram vocabulary, by one forward pass over a trie of the distinct pre-tokens.

A pre-token is a word with the vocabulary's word mark in front. Its best segmentation is the one with the largest sum of
piece scores. Pre-tokens in sorted order walk their trie depth first: the forward state of a prefix is computed once and
shared by all pre-tokens below it, and the state at a pre-token's end gives its token count. States on the current path
are all that is kept, so memory does not grow with the vocabulary of the text. Signs that no piece covers cost one token
per UTF-8 byte, as byte fallback does. Equal scores prefer fewer tokens.

Scores come from a public vocabulary file: its order is by frequency, so the piece at rank r scores ``-log(r + 1)``.
Null and empty texts have 0 tokens. Rows are independent; repeated rows and ids give repeated rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salience.llm.words import as_bytes
from salience.session import ship

MARK = "▁"
#: Score of one byte of a sign that no piece covers.
BYTE_SCORE = -20.0
REMEMBERED = 300_000


class Vocabulary:
    """Pieces with scores, and all their suffixes, which tell when no longer piece can end at a place."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.suffixes = {p[i:] for p in scores for i in range(len(p))}
        self.longest = max(map(len, scores), default=0)

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kept = (i for i in range(model.vocab_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
        return cls({model.id_to_piece(i): -math.log(rank + 1) for rank, i in enumerate(kept)})

    def count(self, pretokens: Iterable[str]) -> dict[str, int]:
        """Token counts of distinct pre-tokens."""
        scores, suffixes, longest = self.scores, self.suffixes, self.longest
        found: dict[str, int] = {}
        best = [0.0]  # best[d], tokens[d]: forward state of the first d signs of the current path
        tokens = [0]
        path = ""
        for word in sorted(pretokens):
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del best[shared + 1:], tokens[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                extra = len(word[end - 1].encode("utf-8", "replace"))
                top, count = best[end - 1] + BYTE_SCORE * extra, tokens[end - 1] + extra
                for start in range(end - 1, max(-1, end - 1 - longest), -1):
                    piece = word[start:end]
                    score = scores.get(piece)
                    if score is not None:
                        score += best[start]
                        n = tokens[start] + 1
                        if score > top or (score == top and n < count):
                            top, count = score, n
                    elif piece not in suffixes:
                        break
                best.append(top)
                tokens.append(count)
            path = word
            found[word] = tokens[-1]
        return found


_vocabularies: dict[str, tuple[Vocabulary, dict[bytes, int]]] = {}


def _counts_of(texts: list[bytes | None], path: str) -> list[tuple[int, int]]:
    if path not in _vocabularies:
        _vocabularies[path] = (Vocabulary.load(path), {})
    vocabulary, known = _vocabularies[path]
    words = [(t or b"").split() for t in texts]
    if len(known) > REMEMBERED:
        known.clear()
    new = {w for ws in words for w in ws if w not in known}
    names = {MARK + w.decode("utf-8", "replace"): w for w in new}
    for name, n in vocabulary.count(names).items():
        known[names[name]] = n
    # distinct byte strings decode alike only when they are not UTF-8
    for w in new:
        if w not in known:
            known[w] = known[names[MARK + w.decode("utf-8", "replace")]]
    return [(len(ws), int(np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)).sum())) for ws in words]


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, n_words and n_tokens, one row per input row; narrow, no shuffle.

    ``vocabulary`` names a file that every worker has.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                counts = _counts_of(as_bytes(part.column("text")), vocabulary)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())],
                    names=["id", "n_words", "n_tokens"])

    return rows.mapInArrow(count, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
