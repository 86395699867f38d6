"""The trie of conversation prefixes: members, children, leaves and saved characters of every node, by depth-band rollup.

Every conversation c is rebuilt: the first h turns of conversation ``c - c % 100`` (all if fewer, none if it is absent), then
its own turns after its first h, with h the crc32 of its decimal id, modulo 6. A node is a distinct sequence of first
turns (role and text); rebuilt conversations that start with it are its members. Turns are taken by number, nulls first;
turns of one number by role, then by the md5 of their text; null roles and texts are empty. Rows without a conversation
id take no part. Repeated rows are turns of their own. Only the four columns named are read. An empty table has no nodes.

*Prefixes.* A sequence of turns is known by a polynomial of the turns' md5 modulo a prime of 127 bits. Polynomials of pieces
can be put together, so a conversation may spread over many tasks: rows are range-sorted without their texts, each task
sums up its piece, and the at most one conversation that goes on at each border is carried over. So a rebuilt
conversation needs no second reading either. Turns are then dealt in segments of ``SEGMENT``, each headed by what is known of its
conversation, with the last ``BAND`` turns of the segment before.

*Bands.* A node carries the ids of its ancestors down from the last depth before its own that is a multiple of ``BAND``. Sums
over subtrees take two steps. Nodes explode to these ancestors only, at most ``BAND`` of them, which completes the sums inside
every band. Then the totals of band roots are completed from the deepest on, in rounds that double the number of bands
they cover, and explode to the band above in the same way. Neither depth nor branching gathers anything in one task:
groupings combine first, and parents with many children are looked up in a broadcast of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salience.llm.graph import stored
from salience.operators.scale import even_join
from salience.session import ship

BAND = 16
SEGMENT = 4096
#: Conversations share the turns of the first in a hundred, at most ``SHARED`` of them.
GROUP, SHARED = 100, 5
CHUNK = 1 << 20
_PRIME = (1 << 127) - 1
_BASE = 0x6C62272E07BB014262B821756295C58D % _PRIME
ROOT = bytes(16)


@lru_cache(maxsize=1 << 14)
def _power(n: int) -> int:
    return pow(_BASE, n, _PRIME)


def _number(raw: bytes | None) -> int:
    return int.from_bytes(raw, "big") if raw else 0


def _raw(number: int) -> bytes:
    return number.to_bytes(16, "big")


def _appended(before: int, piece: int, n: int) -> int:
    """The polynomial of a sequence and then a piece of ``n`` turns."""
    return (before * _power(n) + piece) % _PRIME


def _narrow(conversations: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"), F.length(text).cast("long").alias("chars"))


_CHAIN = "conv_id long, part int, pos long, hash binary, chars long, edge boolean"


def _chained(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and polynomial of every sorted turn, counted from where its conversation begins in this task; ``edge`` marks the
    last turn of the task's first and of its last conversation."""
    part = TaskContext.get().partitionId()
    conv, pos, total, first, waiting = None, 0, 0, True, None
    for batch in batches:
        out = [waiting] if waiting else []
        for c, role, digest, chars in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "digest", "chars"))):
            if c != conv:
                if conv is not None and first:
                    out[-1][-1], first = True, False
                conv, pos, total = c, 0, 0
            pos += 1
            total = (total * _BASE + int.from_bytes(hashlib.md5(role.encode() + digest).digest(), "big") % _PRIME) % _PRIME
            out.append([c, part, pos, _raw(total), chars, False])
        waiting = out.pop() if out else None  # what comes behind decides on its mark
        if out:
            yield _batch(out, _CHAIN)
    if waiting:
        waiting[-1] = True
        yield _batch([waiting], _CHAIN)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}


def _batch(rows: list, ddl: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in ddl.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(list(c), _ARROW[k]) for c, k in zip(zip(*rows), kinds)], names=list(names))


def _chain(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), hash and chars of every turn; ``piece`` turns belong to ``hash``, ``before`` is what precedes."""
    spark = conversations.sparkSession
    order = ["conv_id", "turn", "role", "digest"]
    ranged = _narrow(conversations).repartitionByRange(*order).sortWithinPartitions(*order)
    chain = stored(ranged.mapInArrow(_chained, _CHAIN), "chain")
    # at most two rows a task
    edges = chain.filter("edge").select("part", "conv_id", "pos", "hash").orderBy("part", "conv_id").collect()
    carried, conv, pos, total = [], None, 0, 0
    for e in edges:
        if e["conv_id"] == conv:
            carried.append((e["part"], conv, pos, _raw(total)))
        else:
            conv, pos, total = e["conv_id"], 0, 0
        pos, total = pos + e["pos"], _appended(total, _number(e["hash"]), e["pos"])
    carry = spark.createDataFrame(carried, "part int, conv_id long, passed long, before binary")
    return chain.join(F.broadcast(carry), ["part", "conv_id"], "left").select(
        "conv_id", (F.col("pos") + F.coalesce("passed", F.lit(0))).alias("pos"), F.col("pos").alias("piece"), "hash", "before", "chars")


def _whole(before: bytes | None, hash: bytes, piece: int) -> int:
    return _appended(_number(before), _number(hash), piece) if before else _number(hash)


def _heads(chain: DataFrame) -> DataFrame:
    """One row per conversation: its number of turns, how many it takes from its group's first, and those."""
    turn = F.struct("pos", "piece", "hash", "before", "chars")
    heads = stored(chain.groupBy("conv_id").agg(
        F.max("pos").alias("n"), F.array_sort(F.collect_list(F.when(F.col("pos") <= SHARED, turn))).alias("first")), "heads")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1)).cast("int")
    own = heads.select("conv_id", "n", h.alias("h"), F.when((h > 0) & (h <= F.col("n")), F.get("first", h - 1)).alias("skipped"),
                       (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base_id"))
    base = heads.filter(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base_id"), "first")
    return own.join(base, "base_id", "left").select(
        "conv_id", "n", "h", "skipped", F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.array().cast(base.schema["first"].dataType)).alias("base"))


_MEMBER = "node binary, depth long, chars long, path binary, conv_id long, ends long"


class _Walk:
    """Down one rebuilt conversation: the nodes it is a member of, each with its path inside the band."""

    def __init__(self, conv: int, head: dict, segment: int, turns: int, band: int):
        self.conv, self.h, self.segment, self.turns, self.band = conv, head["h"], segment, turns, band
        self.m = len(head["base"])
        self.length = self.m + max(0, head["n"] - self.h)
        whole = lambda t: _whole(t["before"], t["hash"], t["piece"])
        self.shared = [(whole(t), t["chars"]) for t in head["base"]]
        skipped = whole(head["skipped"]) if head["skipped"] else 0
        self.shift = ((self.shared[-1][0] if self.m else 0) - skipped) % _PRIME
        self.path, self.last = bytearray(), None

    def start(self) -> Iterator[tuple]:
        yield self._node(0, 0, 0)
        for d, (total, chars) in enumerate(self.shared, 1):
            yield self._node(d, total, chars)

    def turn(self, pos: int, total: int, chars: int) -> tuple | None:
        """The node after an own turn; turns of the segment before only make the path."""
        if pos <= self.h:
            return None
        d = self.m + pos - self.h
        node = self._node(d, (total + self.shift * _power(pos - self.h)) % _PRIME, chars)
        return node if (pos - 1) // self.turns == self.segment else None

    def _node(self, depth: int, total: int, chars: int) -> tuple:
        if depth and (depth - 1) % self.band == 0:
            self.path.clear()
        if self.last is not None:
            self.path += self.last
        self.last = _raw(total)
        return self.last, depth, chars, bytes(self.path), self.conv, int(depth == self.length)


def _members(chain: DataFrame, heads: DataFrame, segment: int, band: int) -> DataFrame:
    """(node, depth, chars, path, conv_id, ends) for every node of every rebuilt conversation, stored."""
    whole = F.struct("n", "h", "skipped", "base")
    segments = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / segment))
    front = heads.select("conv_id", F.explode(segments).alias("segment"), F.lit(0).cast("long").alias("pos"), whole.alias("head"))
    at = F.floor((F.col("pos") - 1) / segment)
    # the last turns of a segment are handed on to the next one
    near = F.col("pos") > (at + 1) * segment - band
    turns = chain.withColumn("segment", F.explode(F.when(near, F.array(at, at + 1)).otherwise(F.array(at))))
    both = front.unionByName(turns, allowMissingColumns=True)
    dealt = both.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "pos")

    def run(batches):
        walk = None
        for batch in batches:
            out = []
            for conv, number, pos, head, piece, hash, before, chars in zip(
                    *(batch.column(c).to_pylist() for c in ("conv_id", "segment", "pos", "head", "piece", "hash", "before", "chars"))):
                if pos == 0:
                    walk = _Walk(conv, head, number, segment, band)
                    if number == 0:
                        out += walk.start()
                elif walk.conv == conv and walk.segment == number:  # a segment behind the end has turns of the one before only
                    node = walk.turn(pos, _whole(before, hash, piece), chars)
                    if node:
                        out.append(node)
            for at in range(0, len(out), 4096):
                yield _batch(out[at:at + 4096], _MEMBER)

    return stored(dealt.mapInArrow(run, _MEMBER), "members")


def _ends(members: DataFrame) -> DataFrame:
    """node and the sha256 of the ids that end there, ascending, comma-joined."""
    ddl = "node binary, first long, chunk binary, sha string"

    def run(batches):
        node, first, chunk, rest, opening, out = None, 0, bytearray(), False, True, []
        for batch in batches:
            for key, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
                if key != node:
                    if node is not None:  # the first and the last node may have ends in other tasks
                        whole = not opening and not rest
                        out.append((node, first, None if whole else bytes(chunk), hashlib.sha256(chunk).hexdigest() if whole else None))
                        opening = False
                    node, first, chunk, rest = key, conv, bytearray(), False
                elif len(chunk) > CHUNK:
                    out.append((node, first, bytes(chunk), None))
                    first, chunk, rest = conv, bytearray(), True
                chunk += b",%d" % conv if chunk else b"%d" % conv
            if out:
                yield _batch(out, ddl)
                out = []
        if node is not None:
            yield _batch([(node, first, bytes(chunk), None)], ddl)

    def join(batches):
        node, sha = None, None
        for batch in batches:
            out = []
            for key, chunk in zip(batch.column("node").to_pylist(), batch.column("chunk").to_pylist()):
                if key != node:
                    if node is not None:
                        out.append((node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256(chunk)
                else:
                    sha.update(b"," + chunk)
            if out:
                yield _batch(out, "node binary, sha string")
        if node is not None:
            yield _batch([(node, sha.hexdigest())], "node binary, sha string")

    ranged = members.filter("ends = 1").select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    found = stored(ranged.mapInArrow(run, ddl), "ends")
    cut = found.filter("sha IS NULL").repartition("node").sortWithinPartitions("node", "first").mapInArrow(join, "node binary, sha string")
    return found.filter("sha IS NOT NULL").select("node", "sha").unionByName(cut)


def _given(nodes: DataFrame, leaves: str, saved: str) -> DataFrame:
    """What nodes give to the ancestors on their paths, summed: children, leaves, saved."""
    steps = F.length("path") / 16
    rows = nodes.filter(F.length("path") > 0).select(
        "path", F.col(leaves).alias("leaves"), F.col(saved).alias("saved"), F.posexplode(F.sequence(F.lit(0), (steps - 1).cast("int"))).alias("i", "_"))
    return rows.select(
        F.substr("path", F.col("i") * 16 + 1, F.lit(16)).alias("node"), (F.col("i") + 1 == F.length("path") / 16).cast("long").alias("children"), "leaves", "saved"
    ).groupBy("node").agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])


def _completed(roots: DataFrame, bands: int) -> DataFrame:
    """Band roots (node, path, leaves, saved, sums inside the band) with the sums of their whole subtrees.

    Before round k a root's sums cover 2**k bands, and ``up`` is the root 2**k bands above; roots with that ``up`` hold the next.
    """
    now = stored(roots.withColumn("up", F.when(F.length("path") > 0, F.substr("path", F.lit(1), F.lit(16)))), "roots")
    covered = 1
    while covered < bands:
        below = stored(now.filter("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("weight")), "below")
        sums = now.join(below.drop("weight"), "node", "left").select(
            "node", "path", "up", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")])
        above = now.select(F.col("node").alias("up"), F.col("up").alias("next")).join(below.select(F.col("node").alias("up"), "weight"), "up")
        jumped = even_join(sums.filter("up IS NOT NULL"), above, ["up"], "weight")
        now = stored(jumped.select("node", "path", F.col("next").alias("up"), "leaves", "saved").unionByName(sums.filter("up IS NULL").select("node", "path", "up", "leaves", "saved")), "roots")
        covered *= 2
    return now


def prefix_trie(conversations: DataFrame, band: int = BAND, segment: int = SEGMENT) -> DataFrame:
    """A row per node: node (an id), conv_id, depth, parent, parent_conv_id, n_convs, n_children, n_leaves, saved, ends_sha256.

    ``segment`` is more than ``band``, and ``band`` more than the turns that a conversation can take from another.
    """
    spark: SparkSession = conversations.sparkSession
    ship(spark)
    chain = _chain(conversations)
    members = _members(chain, _heads(chain), segment, band)
    # depth, chars and path follow from the node
    nodes = members.groupBy("node", "depth", "chars", "path").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("ends").alias("n_ends"))
    nodes = stored(nodes.withColumn("leaf", (F.col("n_convs") == F.col("n_ends")).cast("long")).withColumn("saving", (F.col("n_convs") - 1) * F.col("chars")), "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    band_root = (F.col("depth") % band == 0) & (F.col("depth") > 0)
    given = _given(nodes.filter(~band_root), "leaf", "saving")
    if deepest >= band:
        given = stored(given, "given")
        roots = nodes.filter(F.col("depth") % band == 0).join(given.drop("children"), "node", "left").select(
            "node", "path", (F.col("leaf") + F.coalesce("leaves", F.lit(0))).alias("leaves"), (F.col("saving") + F.coalesce("saved", F.lit(0))).alias("saved"))
        totals = _completed(roots, deepest // band + 1)
        above = _given(totals, "leaves", "saved")
        given = given.unionByName(above).groupBy("node").agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
    none = hashlib.sha256(b"").hexdigest()
    full = nodes.join(given, "node", "left").join(_ends(members), "node", "left").select(
        "node", "conv_id", "depth", F.when(F.col("depth") > 0, F.substr("path", F.length("path") - 15, F.lit(16))).alias("parent"), "n_convs",
        F.coalesce("children", F.lit(0)).alias("n_children"), (F.col("leaf") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saving") + F.coalesce("saved", F.lit(0))).alias("saved"), F.coalesce("sha", F.lit(none)).alias("ends_sha256"))
    full = stored(full, "full")
    parents = full.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    placed = even_join(full.filter("depth > 0"), parents, ["parent"], "weight")
    return placed.unionByName(full.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
