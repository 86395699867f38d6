"""Scores from stored vectors: pooling, salience, greedy token matching, and model jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salience.functions import text as tx
from salience.functions.documents import hash_bucket
from salience.functions.text import r6
from salience.operators.scale import dealt, even_join, heavy_keys

TILE = 128
CUTS = 64
#: Calls of a model whose vectors are sent back at once.
CALLS = 32
#: Characters of leave-one-out texts that are written out at once, one text at least.
CONTEXT_CHARS = 1 << 22
#: Bytes of a word as 1 and all others as 0, and the others.
WORD_BYTES = bytes(chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" for b in range(256))
OTHER_BYTES = bytes(b for b in range(256) if not WORD_BYTES[b])
EPSILON = 1e-8
SMALLEST_COUNT = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm(v)), F.lit(0.0)))


def vector_sum(v: str, dims: int) -> Column:
    """Aggregate: element-wise sum. One sum per dimension, combined map-side; no element ever becomes a row."""
    return F.array(*[F.sum(F.get(v, F.lit(i))) for i in range(dims)])


def as_doubles(v: str) -> Column:
    return F.transform(F.col(v), lambda x: x.cast("double"))


def salience(vectors: DataFrame, group: str, key: str, dims: int) -> DataFrame:
    """Cosine of each unit vector and the mean of the others in its group; 0 when it is alone, zero, or
    the others cancel out.

    Group sums come from partial sums. They go back to the members through a join that stays even when one group
    holds most vectors.
    """
    rows = vectors.select(group, key, as_doubles("v").alias("v")).withColumn("v", unit(F.col("v")))
    sums = rows.groupBy(group).agg(vector_sum("v", dims).alias("s"), F.count("*").alias("n"), F.count("*").alias("_w"))
    rest = F.zip_with("s", "v", lambda s, x: (s - x) / (F.col("n") - 1))
    both = even_join(rows, sums, [group], "_w").withColumn("rest", F.when(F.col("n") > 1, rest))
    return both.select(group, key, r6(F.coalesce(F.try_divide(dot(F.col("v"), F.col("rest")), norm(F.col("rest"))), F.lit(0.0))).alias("score"))


def pooled(tokens: DataFrame, key: str, dims: int) -> DataFrame:
    """Mean of the unmasked token vectors of each text, scaled to length 1; zero when all are masked."""
    kept = tokens.select(key, F.col("mask").cast("double").alias("m"), as_doubles("v").alias("v"))
    sums = kept.groupBy(key).agg(
        F.array(*[F.sum(F.col("m") * F.get("v", F.lit(i))) for i in range(dims)]).alias("s"), F.sum("m").alias("n"))
    mean = sums.select(key, F.transform("s", lambda x: x / F.greatest(F.col("n"), F.lit(SMALLEST_COUNT))).alias("mean"))
    return mean.select(key, unit(F.col("mean")).alias("v"))


@F.pandas_udf(T.StructType([T.StructField("cand", T.ArrayType(T.DoubleType())), T.StructField("ref", T.ArrayType(T.DoubleType()))]))
def _tile_maxima(cand: pd.Series, ref: pd.Series) -> pd.DataFrame:
    def one(c, r):
        x, y = np.stack(list(c)), np.stack(list(r))
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), SMALLEST_COUNT)
        y = y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), SMALLEST_COUNT)
        sim = x @ y.T
        return sim.max(axis=1), sim.max(axis=0)

    found = [one(c, r) for c, r in zip(cand, ref)]
    return pd.DataFrame({"cand": [f[0] for f in found], "ref": [f[1] for f in found]})


def greedy_match(tokens: DataFrame, baseline: float | None = None) -> DataFrame:
    """Token-vector F1 of ``pair_id, side (cand/ref), pos, special, v``.

    Each token takes its best cosine on the other side. Tokens are packed into tiles of at most 128, and one small
    matrix product per pair of tiles yields its row and column maxima, so neither long texts nor a pair with very
    many tokens gathers in one place, and token pairs never become rows. A pair that holds much of the work is
    spread over several join keys.
    """
    kept = tokens.filter(~F.col("special"))
    tiles = kept.groupBy("pair_id", "side", F.floor(F.col("pos") / TILE).alias("tile")).agg(
        F.array_sort(F.collect_list(F.struct("pos", as_doubles("v").alias("v")))).alias("t"))
    # pairs that hold over 1/1000 of all tile products, at most 1000, are cut along the candidate tiles
    n_tiles = lambda s: F.count_if(F.col("side") == s)
    per_pair = tiles.select("pair_id", "side").groupBy("pair_id").agg(n_tiles("cand").alias("n"), (n_tiles("cand") * n_tiles("ref")).alias("_w"))
    big = per_pair.filter(heavy_keys(per_pair, "_w", 1000) & (F.col("n") > 1)).select("pair_id", F.least("n", F.lit(CUTS)).alias("cuts"))
    cut = tiles.join(F.broadcast(big), "pair_id", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    side = lambda s, k, part: cut.filter(F.col("side") == s).select(
        "pair_id", part.alias("part"), F.transform("t", lambda x: x["pos"]).alias(f"{k}_pos"), F.transform("t", lambda x: x["v"]).alias(f"{k}_v"))
    cand = side("cand", "c", F.pmod("tile", "cuts"))
    ref = side("ref", "r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    met = cand.join(ref, ["pair_id", "part"]).withColumn("m", _tile_maxima("c_v", "r_v"))
    best = met.select("pair_id", F.explode(F.concat(
        F.zip_with("c_pos", "m.cand", lambda p, x: F.struct(F.lit("cand").alias("side"), p.alias("pos"), x.alias("x"))),
        F.zip_with("r_pos", "m.ref", lambda p, x: F.struct(F.lit("ref").alias("side"), p.alias("pos"), x.alias("x"))))).alias("b"))
    each = best.groupBy("pair_id", "b.side", "b.pos").agg(F.max("b.x").alias("x"))
    # a pair of which one side has no usable token matches nothing
    found = each.groupBy("pair_id").agg(
        F.avg(F.when(F.col("side") == "cand", F.col("x"))).alias("p"), F.avg(F.when(F.col("side") == "ref", F.col("x"))).alias("r"))
    pr = tokens.select("pair_id").distinct().join(found, "pair_id", "left").na.fill(0.0, ["p", "r"])
    f1 = F.lit(2.0) * F.col("p") * F.col("r") / (F.col("p") + F.col("r") + F.lit(EPSILON))
    scaled = (lambda x: (x - baseline) / (1.0 - baseline)) if baseline is not None else (lambda x: x)
    return pr.select("pair_id", r6(scaled(F.col("p"))).alias("precision"), r6(scaled(F.col("r"))).alias("recall"), r6(scaled(f1)).alias("f1"))


def hashed_bag_encoder(buckets: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Default text encoder: word counts in hashed buckets, scaled to length 1.

    The words of a call are cut out of its bytes at once, and each distinct word is hashed once a call.
    """

    def encode(texts: list[str]) -> np.ndarray:
        coded = [t.lower().encode() for t in texts]
        raw = b" ".join([b"", *coded, b""])
        inside = np.frombuffer(raw.translate(WORD_BYTES), bool)
        first, behind = (np.flatnonzero(x) + 1 for x in (~inside[:-1] & inside[1:], inside[:-1] & ~inside[1:]))
        offsets = np.concatenate([[0], np.cumsum(behind - first)])
        words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(raw.translate(None, OTHER_BYTES))).dictionary_encode()
        bucket = np.array([hash_bucket(w, buckets) for w in words.dictionary.to_pylist()], np.int64)
        of = np.searchsorted(np.cumsum([len(x) + 1 for x in coded]), first, "left")
        out = np.bincount(of * buckets + bucket[words.indices.to_numpy()], minlength=len(texts) * buckets).reshape(-1, buckets).astype(float)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size == 0.0, 1.0, size)

    return encode


def encode_texts(texts: DataFrame, key: str, column: str, make_encoder: Callable[[], Callable], batch: int = 64) -> DataFrame:
    """Runs a text model over a table: ``key, v``.

    The model is made inside the task, on its first batch, so an empty partition loads nothing. Rows are sorted
    by length inside each partition; a batch then holds texts of similar length and padding stays small.
    """

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for table in tables:
            model = model or make_encoder()
            # some calls' vectors go back together
            for at in range(0, table.num_rows, batch * CALLS):
                some = table.slice(at, batch * CALLS)
                texts = some.column(column).to_pylist()
                made = [np.asarray(model(texts[lo:lo + batch]), np.float64) for lo in range(0, len(texts), batch)]
                ends = np.cumsum([0, *(len(v) for x in made for v in x)]).astype(np.int32)
                flat = np.concatenate([np.ravel(x) for x in made])
                yield pa.RecordBatch.from_arrays([some.column(key), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [key, "v"])

    rows = texts.select(key, F.coalesce(column, F.lit("")).alias(column)).sortWithinPartitions(F.length(column))
    return rows.mapInArrow(run, T.StructType([texts.schema[key], T.StructField("v", T.ArrayType(T.DoubleType()))]))


def distinct_contexts(rows: DataFrame, column: str) -> DataFrame:
    """``context_hash, text, copies``: each distinct text once."""
    return rows.groupBy(F.sha2(F.col(column), 256).alias("context_hash")).agg(
        F.any_value(column).alias("text"), F.count("*").alias("copies"))


def score_once(rows: DataFrame, column: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs ``score`` on distinct texts only and fans its columns back to all rows.

    ``score`` maps ``context_hash, text`` to ``context_hash`` and results. Texts with very many copies go back by a
    broadcast of bounded size, all others by a shuffle.
    """
    distinct = distinct_contexts(rows, column)
    results = score(distinct.select("context_hash", "text")).join(distinct.select("context_hash", "copies"), "context_hash")
    return even_join(rows.withColumn("context_hash", F.sha2(F.col(column), 256)), results, ["context_hash"], "copies")


def contexts(sents: list[str]) -> Iterator[str]:
    """The leave-one-out texts of a document: all its sentences but one, joined by a blank."""
    text, at = " ".join(sents), 0
    for s in sents:
        end = at + len(s)
        yield text[:at] + text[end + 1:] if end < len(text) else text[:max(at - 1, 0)]
        at = end + 1


def in_batches(model: Callable, texts: list[str], batch: int) -> np.ndarray:
    """Vectors of the texts in their order; a call takes texts of similar length."""
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    made = np.concatenate([np.asarray(model([texts[i] for i in order[lo:lo + batch]]), np.float64) for lo in range(0, len(order), batch)])
    out = np.empty_like(made)
    out[order] = made
    return out


def encoded_context_similarity(docs: DataFrame, make_encoder: Callable[[], Callable], batch: int = 64) -> DataFrame:
    """Cosine of each sentence and its leave-one-out text under any text encoder; a single sentence scores 0.

    For encoders that are no sum over words, the leave-one-out texts have to be written out, one per sentence. A task writes
    them from the row of their document, some at a time, encodes them with their sentences and keeps the cosine alone, so neither
    these texts nor vectors are shuffled, sorted or spilled. Rows of one id and number are one sentence.
    """

    def scored(model: Callable, own: list[str], rest: list[str]) -> np.ndarray:
        x, y = np.split(in_batches(model, own + rest, batch), 2)
        size = np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))
        return np.divide((x * y).sum(axis=1), size, out=np.zeros(len(size)), where=size != 0)

    def run(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None

        def sent_back(held: list[tuple]) -> pa.RecordBatch:
            ids, sids, own, rest = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(sids, pa.int64()), pa.array(scored(model, [*own], [*rest]))], ["doc_id", "sid", "score"])

        for table in tables:
            model = model or make_encoder()
            kind = table.schema.field("doc_id").type
            held, chars = [], 0
            for i, doc in enumerate(table.column("doc_id")):
                sents = table.column("sents")[i].as_py() or []
                for sid, (own, rest) in enumerate(zip(sents, contexts(sents))):
                    if held and (chars + len(rest) > CONTEXT_CHARS or len(held) == batch * CALLS):
                        yield sent_back(held)
                        held, chars = [], 0
                    held.append((doc.as_py(), sid, own, rest))
                    chars += len(rest)
            if held:
                yield sent_back(held)

    rows = dealt(docs.select("doc_id", "text")).select("doc_id", tx.sentences(F.col("text")).alias("sents"))
    found = rows.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("sid", T.LongType()), T.StructField("score", T.DoubleType())]))
    return found.groupBy("doc_id", "sid").agg(r6(F.max("score")).alias("score"))
