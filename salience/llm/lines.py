"""Near-duplicate lines of documents, found by an exact set-similarity join; later ones are removed.

A line's tokens are its distinct shingles of ``words`` words, A-Z lower-cased. With ``short``, a line of fewer words has its
whole sequence as its one token, so it goes if an earlier line has the same words; without, such lines are left alone. Tokens are ordered by rarity; similar lines share one in their prefixes (``prefixes``). Length and
positional filters drop pairs that cannot overlap enough, the rest is verified on whole sets. A line goes if any earlier
line, in the order of document id, text hash and line number, is equal or has a Jaccard of at least num/den; whether that
earlier line is removed itself does not matter, so the result does not depend on the order of work.

Equal lines are one set with a first place; all its other places go without any pair. A set is first held against the
earliest one of its rarest key, so a large group of near copies costs one comparison per line. Sets that stay open meet
the earlier ones of their keys in slices of bounded size. Besides length and position the filters use small maps of the
sets: each token turns over one of ``MAP_BITS`` bits, so two sets differ in at least as many tokens as their maps in bits.

Ids are whole numbers (null: before all others). Rows equal in id and text count as one document and get the same result.
Null and empty texts have no lines. Blank lines stay. Only the id and the text column decide; others travel along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salience.llm.blocks import matrix
from salience.llm.graph import stored
from salience.llm.meeting import meet_by_key
from salience.llm.prefixes import Similarity, shared_prefixes
from salience.llm.words import TokenSets, column_bytes, overlap
from salience.session import ship

WORDS = 5
FILTER_BITS = 1 << 22
NULL_ID = -(1 << 63)
#: Bits of a set's map, in which each token turns one bit over.
MAP_BITS = 256
_ONE = np.uint64(1)


def line_counts(column: pa.Array) -> np.ndarray:
    """Lines of each text; null and empty texts have none."""
    raw, offsets = column_bytes(column)
    return np.where(np.diff(offsets) > 0, np.diff(np.searchsorted(np.flatnonzero(raw == 10), offsets)) + 1, 0)


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def _line_sets(rows: DataFrame, words: int, similarity: Similarity, short: bool) -> DataFrame:
    """node, id, hash, line, n, n_low, d1, d2, low of every long enough line, with ``short`` of all but blank ones, stored.

    A row with line -1 stands for each document; its n is the number of lines.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                sets = TokenSets.of_lines(part.column("text"), words, short)
                take = pa.array(sets.row)
                n_low, low = sets.low(similarity)
                d1, d2 = sets.digests()
                none = np.zeros(part.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("hash"), pa.array(none - 1), pa.array(line_counts(part.column("text"))), pa.array(none), pa.array(none),
                     pa.array(none), pa.array([[]] * part.num_rows, pa.list_(pa.int64()))], names=["id", "hash", "line", "n", "n_low", "d1", "d2", "low"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(take), part.column("hash").take(take), pa.array(sets.line), pa.array(sets.sizes()),
                     pa.array(n_low), pa.array(d1), pa.array(d2), low],
                    names=["id", "hash", "line", "n", "n_low", "d1", "d2", "low"])

    made = rows.mapInArrow(run, "id long, hash long, line long, n long, n_low long, d1 long, d2 long, low array<bigint>")
    return stored(made.withColumn("node", F.monotonically_increasing_id()), "lines")


def _bits(values: DataFrame) -> np.ndarray:
    """A filter of fixed size over a hashed column x; at most FILTER_BITS / 64 rows reach the driver."""
    bit = F.pmod(F.col("x"), F.lit(FILTER_BITS))
    rows = values.select(F.floor(bit / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("mask"))
    found = rows.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found["word"].to_numpy()] = found["mask"].to_numpy()
    return out.view(np.uint64)


def _has(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    spot = x % FILTER_BITS
    return (bits[spot >> 6] >> (spot & 63).astype(np.uint64)) & _ONE != 0


PLACE = ["id", "hash", "line"]
_FIRST = ["d1", "d2", "n", *PLACE, "node", "places"]


def _earliest(rows: pa.Table) -> pa.Table:
    """One row per set, at its earliest place, with the number of its places."""
    c = {name: rows[name].to_numpy() for name in _FIRST}
    order = np.lexsort(tuple(c[name] for name in reversed(_FIRST[:-1])))
    c = {name: v[order] for name, v in c.items()}
    new = np.ones(len(order), bool)
    new[1:] = (c["d1"][1:] != c["d1"][:-1]) | (c["d2"][1:] != c["d2"][:-1]) | (c["n"][1:] != c["n"][:-1])
    at = np.flatnonzero(new)
    out = {name: pa.array(v[at]) for name, v in c.items()}
    out["places"] = pa.array(np.add.reduceat(c["places"], at) if len(at) else at)
    return pa.table(out)


def _firsts(lines: DataFrame, groups: int) -> DataFrame:
    """d1, d2, n, the earliest place with its node, and the number of places of every set, stored.

    Batches keep the earliest place of each of their sets before rows are shuffled, so a common line is not hot.
    """
    def batchwise(batches):
        for batch in batches:
            if batch.num_rows:
                yield from _earliest(pa.Table.from_batches([batch])).to_batches()

    schema = ", ".join(f"{c} long" for c in _FIRST)
    own = lines.select(*_FIRST[:-1], F.lit(1).cast("long").alias("places")).mapInArrow(batchwise, schema)
    dealt = own.withColumn("group", F.pmod("d1", F.lit(groups)))
    return stored(dealt.groupBy("group").applyInArrow(lambda t: _earliest(t.select(_FIRST)), schema), "firsts")


def _maps(sets: TokenSets, chosen: np.ndarray) -> list[bytes]:
    number = np.full(len(sets.row), -1)
    number[chosen] = np.arange(len(chosen))
    of = number[sets.owners()]
    tokens, of = sets.tokens[of >= 0], of[of >= 0]
    cells = of * MAP_BITS + (tokens * 0x9E3779B1 >> 20) % MAP_BITS
    turns = (np.bincount(cells, minlength=len(chosen) * MAP_BITS) & 1).astype(np.uint8).reshape(-1, MAP_BITS)
    return [row.tobytes() for row in np.packbits(turns, axis=1)]


def _whole_sets(rows: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, tokens, map) of wanted lines (node, id, hash, line, d1), from a second pass over the texts that hold them, stored."""
    context = rows.sparkSession.sparkContext
    texts, lines = context.broadcast(_bits(wanted.select(F.col("hash").alias("x")))), context.broadcast(_bits(wanted.select(F.col("d1").alias("x"))))

    def run(batches):
        for batch in batches:
            some = np.flatnonzero(_has(texts.value, batch.column("hash").to_numpy()))
            for at in range(0, len(some), 400):
                part = batch.take(pa.array(some[at:at + 400]))
                sets = TokenSets.of_lines(part.column("text"), words)
                hit = np.flatnonzero(_has(lines.value, sets.digests()[0]))
                take = pa.array(sets.row[hit])
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(take), part.column("hash").take(take), pa.array(sets.line[hit]),
                     pa.array([sets.set(i).tobytes() for i in hit], pa.binary()), pa.array(_maps(sets, hit), pa.binary())],
                    names=["id", "hash", "line", "tokens", "map"])

    made = rows.mapInArrow(run, "id long, hash long, line long, tokens binary, map binary")
    return stored(made.join(wanted, PLACE).select("node", "tokens", "map"), "tokens")


def _verified(pairs: DataFrame, tokens: DataFrame, similarity: Similarity) -> DataFrame:
    """(node,) of pairs (node, earlier) that are similar enough."""
    both = pairs.join(tokens.select("node", F.col("tokens").alias("x")), "node").join(
        tokens.select(F.col("node").alias("earlier"), F.col("tokens").alias("y")), "earlier").select("node", "x", "y")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                keep.append(overlap(x, y) >= similarity.need(len(x), len(y)))
            yield batch.select(["node"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "node long").distinct()


def _earlier_pairs(similarity: Similarity):
    """Pairs (node, earlier) of rows of a key that pass the order, length, positional and map filters."""

    def meet(rows: pa.Table, probes: pa.Table) -> pa.Table:
        pairs = [np.zeros((0, 2), np.int64)]
        if rows.num_rows and probes.num_rows:
            rows = rows.sort_by("key")
            r, p = ({c: t[c].to_numpy() for c in ("key", "node", "n", "place", *PLACE)} for t in (rows, probes))
            r_map, p_map = (matrix(t["map"], np.uint64) for t in (rows, probes))
            lo, hi = np.searchsorted(r["key"], p["key"], "left"), np.searchsorted(r["key"], p["key"], "right")
            at = 0
            while at < len(lo):
                # as many probes at once as make about a hundred thousand pairs
                upto = max(at + 1, at + int(np.searchsorted(np.cumsum(hi[at:] - lo[at:]), 100_000)))
                width = hi[at:upto] - lo[at:upto]
                a = np.repeat(np.arange(at, upto), width)
                b = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(lo[at:upto], width)
                before = r["line"][b] < p["line"][a]
                for name in ("hash", "id"):
                    x, y = r[name][b], p[name][a]
                    before = (x < y) | ((x == y) & before)
                n, m = p["n"][a], r["n"][b]
                need = similarity.need(n, m)
                fit = before & (np.minimum(n - p["place"][a], m - r["place"][b]) >= need)
                a, b, need = a[fit], b[fit], need[fit]
                bound = (p["n"][a] + r["n"][b] - np.bitwise_count(p_map[a] ^ r_map[b]).sum(axis=1, dtype=np.int64)) // 2
                fit = bound >= need
                found = np.column_stack([p["node"][a[fit]], r["node"][b[fit]]])
                pairs.append(found)
                at = upto
        found = np.unique(np.concatenate(pairs), axis=0)
        return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["node", "earlier"])

    return meet


def line_report(docs: DataFrame, words: int = WORDS, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
                short: bool = False) -> DataFrame:
    """(id, hash, n_lines, removed) of every document; removed are line numbers from 0 in order, hash is xxhash64 of the text.

    A null id is ``NULL_ID`` here. ``short`` also removes repeats of lines with fewer than ``words`` words.
    """
    ship(docs.sparkSession)
    similarity = Similarity(num, den)
    rows = _documents(docs, id_col, text_col)
    table = _line_sets(rows, words, similarity, short)
    lines = table.filter("line >= 0")
    equal = ["d1", "d2", "n"]
    firsts = _firsts(lines, max(1, lines.count() // 200_000))
    # a set of one token is similar to equal ones only, if one of two tokens is too little
    joining = lines.filter("n > 1") if similarity.need(1, 2) > 1 else lines
    prefixes = shared_prefixes(joining, firsts, similarity, [*PLACE, "d1"])
    # the earliest set of a key leads it; keys of one set alone join nothing
    spot = F.struct(*PLACE, "node").alias("spot")
    lead = prefixes.select("key", spot).groupBy("key").agg(F.min("spot").alias("lead"), F.count("*").alias("n"))
    lead = stored(lead.filter("n > 1").select("key", F.col("lead.node").alias("lead")), "leaders")
    routed = stored(prefixes.join(lead, "key"), "routed")
    tokens = _whole_sets(rows, routed.select("node", *PLACE, "d1").distinct(), words)

    # first against the leader of the rarest key, then, if that is not similar, against all earlier sets of all keys
    led = routed.filter("node <> lead")
    gone = stored(_verified(led.groupBy("node").agg(F.min_by("lead", "place").alias("earlier")), tokens, similarity), "settled")
    probes = stored(led.join(gone, "node", "left_anti").join(tokens.select("node", "map"), "node").drop("lead", "d1"), "probes")
    asked = probes.select("key").distinct()
    base = stored(routed.join(asked, "key", "left_semi").join(tokens.select("node", "map"), "node").drop("lead", "d1"), "base")
    pairs = meet_by_key(base, probes, _earlier_pairs(similarity), "node long, earlier long").distinct()
    gone = stored(gone.unionByName(_verified(pairs, tokens, similarity)), "gone")

    affected = firsts.join(gone.select("node", F.lit(True).alias("gone")), "node", "left").filter("gone OR places > 1")
    affected = stored(affected.select(*equal, "gone", F.struct(*PLACE).alias("first")), "affected")
    hits = lines.select(*equal, *PLACE).join(affected, equal).filter(F.coalesce("gone", F.lit(False)) | (F.struct(*PLACE) != F.col("first")))
    removed = hits.groupBy("id", "hash").agg(F.array_sort(F.collect_set("line")).alias("removed"))
    own = table.filter("line = -1").select("id", "hash", F.col("n").alias("n_lines"))
    return own.join(removed, ["id", "hash"], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<bigint>")))


def removed_lines(docs: DataFrame, words: int = WORDS, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
                  short: bool = False) -> DataFrame:
    """(id, hash, removed) of the documents that lose lines, once each."""
    report = line_report(docs, words, num, den, id_col, text_col, short).filter(F.size("removed") > 0)
    return report.select("id", "hash", "removed").dropDuplicates(["id", "hash"])


def dedup_lines(docs: DataFrame, words: int = WORDS, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
                drop_emptied: bool = False, short: bool = False) -> DataFrame:
    """The documents with the text that is left; with ``drop_emptied`` those that lose all their words are left out."""
    removed = removed_lines(docs, words, num, den, id_col, text_col, short).select(
        F.col("id").alias("_lines_id"), F.col("hash").alias("_lines_hash"), F.col("removed").alias("_lines_removed"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID))
    text = F.col(text_col)
    joined = docs.join(removed, (key == F.col("_lines_id")) & (F.xxhash64(text.cast("string")) == F.col("_lines_hash")), "left")
    left = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col("_lines_removed"), i.cast("long")))
    changed = joined.withColumn(text_col, F.when(F.col("_lines_removed").isNotNull(), F.array_join(left, "\n")).otherwise(text))
    if drop_emptied:
        changed = changed.filter(F.col("_lines_removed").isNull() | F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    return changed.select(*docs.columns)
