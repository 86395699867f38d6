"""Entity spans by rule, as an Arrow UDF, and tests on entities, as expressions on arrays in one row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salience.functions.documents import CUT_BYTES, ranges

# Entity type to category; types not named here are entities.
CATEGORIES = {
    "PERSON": "entity", "ORG": "entity", "NORP": "entity", "FAC": "entity", "GPE": "entity", "LOC": "entity",
    "PRODUCT": "entity", "WORK_OF_ART": "entity", "EVENT": "entity",
    "PERCENT": "number", "MONEY": "number", "QUANTITY": "number", "CARDINAL": "number",
    "DATE": "date", "TIME": "date",
}
DEFAULT_CATEGORY = "entity"

# Numbers with sign or unit, and runs of capitalized words.
SPAN = r"[$€£]?\d+(?:[.,]\d+)*%?|\p{Lu}\p{L}*(?: \p{Lu}\p{L}*)*"


def category(ent_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ent_type), F.lit(DEFAULT_CATEGORY))


_SPAN = regex.compile(SPAN.replace(r"\d", "[0-9]"))
_YEAR = regex.compile("(?:19|20)[0-9][0-9]")
_ENTITY = pa.struct([("text", pa.string()), ("start_idx", pa.int64()), ("end_idx", pa.int64()), ("ent_type", pa.string()),
                     ("tokens", pa.list_(pa.string())), ("i", pa.list_(pa.int64()))])


@lru_cache(maxsize=100_000)
def span_type(text: str) -> str:
    if text[0] in "$€£":
        return "MONEY"
    if text.endswith("%"):
        return "PERCENT"
    if _YEAR.fullmatch(text):
        return "DATE"
    if text[0] in "0123456789":
        return "CARDINAL"
    return {0: "GPE", 1: "PERSON"}.get(text.count(" "), "ORG")


def _found(text: str | None, token_ids: bool) -> Iterator[tuple]:
    at, blanks = 0, 0
    for m in _SPAN.finditer(text or ""):
        whole, lo = m[0], m.start()
        parts = whole.split(" ")
        if token_ids:
            blanks += text.count(" ", at, lo)
            at = lo
        yield whole, lo, m.end(), span_type(whole), parts, [blanks + k for k in range(len(parts))] if token_ids else []


def spans(text: str | None, token_ids: bool = False) -> list[dict]:
    """Entities of a text in order, with character offsets, in one scan.

    ``token_ids`` adds the numbers of the blank-separated tokens a span covers.
    """
    return [dict(zip(_ENTITY.names, e)) for e in _found(text, token_ids)]


def span_lists(texts: list[str | None], token_ids: bool = False) -> pa.Array:
    """The same for many texts, as one list array."""
    each = [list(_found(t, token_ids)) for t in texts]
    flat = [e for found in each for e in found]
    ends = lambda lists: pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))
    columns = list(zip(*flat)) or [()] * len(_ENTITY)
    made = [pa.array(c, f.type) if not pa.types.is_list(f.type) else pa.ListArray.from_arrays(ends(c), pa.array([x for v in c for x in v], f.type.value_type))
            for f, c in zip(_ENTITY, columns)]
    return pa.ListArray.from_arrays(ends(each), pa.StructArray.from_arrays(made, fields=list(_ENTITY)))


_TEXTS, _LONGS = T.ArrayType(T.StringType()), T.ArrayType(T.LongType())
_ENTITIES = T.ArrayType(T.StructType([
    T.StructField("text", T.StringType()), T.StructField("start_idx", T.LongType()), T.StructField("end_idx", T.LongType()),
    T.StructField("ent_type", T.StringType()), T.StructField("tokens", _TEXTS), T.StructField("i", _LONGS)]))


def byte_cuts(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with bounded bytes of text."""
    return ranges(np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))]), CUT_BYTES)


@F.arrow_udf(T.StructType([T.StructField("summary_ents", _ENTITIES), T.StructField("document_ents", _ENTITIES)]))
def annotations(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Entities of both texts; the document's are looked for only when the summary has some. Worked on in slices of bounded bytes."""
    for summary, document in columns:
        for lo, hi in byte_cuts(document):
            own = span_lists(summary.slice(lo, hi - lo).to_pylist(), token_ids=True)
            some = own.value_lengths().to_pylist()
            found = span_lists([d if n else None for n, d in zip(some, document.slice(lo, hi - lo).to_pylist())])
            yield pa.StructArray.from_arrays([own, found], names=["summary_ents", "document_ents"])


def known_words(ents: Column) -> Column:
    return F.array_union(F.transform(ents, lambda e: e["text"]), F.flatten(F.transform(ents, lambda e: e["tokens"])))


def _inside(inner: Column, outer: Column) -> Column:
    return F.size(F.array_except(inner, outer)) == 0


def unsupported(ent: Column, known: Column) -> Column:
    """Neither the entity's text nor all of its tokens are known words."""
    return ~(F.array_contains(known, ent["text"]) | _inside(ent["tokens"], known))


def supported_by(ent: Column, doc_ents: Column) -> Column:
    """Some document entity of the same category has all the tokens, or has no others."""
    same = category(ent["ent_type"])
    return F.exists(doc_ents, lambda d: (category(d["ent_type"]) == same) & (_inside(ent["tokens"], d["tokens"]) | _inside(d["tokens"], ent["tokens"])))


def first_replacement(ent: Column, doc_ents: Column) -> Column:
    """The first document entity made of the entity's tokens only."""
    return F.get(F.filter(doc_ents, lambda d: _inside(d["tokens"], ent["tokens"])), F.lit(0))
