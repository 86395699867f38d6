"""Documents linked by the Jaccard similarity of their word shingles, found with trees over count vectors.

The shingles of a document are hashed into ``GROUPS`` groups; how many fall into each is its count vector. The overlap of
two documents is at most the summed minima of their vectors, and the overlap with any document below a tree node is at
most the summed minima with the node's coordinate maxima. Subtrees whose bound misses the overlap that a link needs are
skipped, and the pairs that survive are verified on the whole sets.

One tree over everything would prune nothing: vectors of unrelated texts of a length are alike, their boxes cover each
other, and all pairs of a length would be compared. So there is a tree per routing key: documents meet under the tokens
of their rarity-ordered prefix (``prefixes``), of which linked documents share at least one. Nothing is lost by that.

Keys with the same first node are one family, so documents that share many keys meet once. Groups of copies are
contracted before pairs are formed: equal sets are one node; nodes are held against one leader of like size, which turns
a group of near copies into a star; then those outside the largest component of a family try their ``TRIED`` most
promising partners. Only what is in different components after that meets as a whole, in slices of bounded size. So no
family emits all its pairs, and no link between different components is missed.

Words are runs of signs other than white space, A-Z lower-cased. Fewer words than a shingle make one shingle; null and
empty texts have none and link with nothing. A null id has no component. Repeated ids are separate documents until the
end, where the component of an id is given for each of its rows. Only the id and the text column are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salience.llm.blocks import matrix
from salience.llm.graph import components, stored
from salience.llm.meeting import meet_by_key
from salience.llm.prefixes import Similarity, shared_prefixes
from salience.llm.words import TokenSets, overlap
from salience.session import ship

GROUPS = 512
FAN = 16
TRIED = 3
#: Bits of the filter that keeps most other documents out of the second pass over the texts.
FILTER_BITS = 1 << 22
_ONE = np.uint64(1)


def count_vectors(sets: TokenSets) -> np.ndarray:
    """Counts per group in a byte, a row per set; 255 stands for any larger count as well."""
    cells = np.bincount(sets.owners() * GROUPS + (sets.tokens & (GROUPS - 1)), minlength=len(sets.row) * GROUPS)
    return np.minimum(cells, 255).astype(np.uint8).reshape(-1, GROUPS)


class CountTree:
    """A packed R-tree over count vectors; level 0 holds the points, every level above boxes of ``FAN`` below."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        # sort-tile: by size, then inside slabs of like size by the coordinate that varies most
        order = np.argsort(sizes, kind="stable")
        slab = max(FAN, int(np.ceil(np.sqrt(len(order) / FAN))) * FAN)
        widest = int(np.argmax(vectors.var(axis=0))) if len(order) else 0
        order = np.concatenate([s[np.argsort(vectors[s, widest], kind="stable")] for s in np.split(order, range(slab, len(order), slab))])
        self.order = order
        self.levels = [(vectors[order], sizes[order])]
        while len(self.levels[-1][1]) > FAN:
            high, least = self.levels[-1]
            starts = np.arange(0, len(least), FAN)
            self.levels.append((np.maximum.reduceat(high, starts, axis=0), np.minimum.reduceat(least, starts)))

    def search(self, vectors: np.ndarray, sizes: np.ndarray, similarity: Similarity) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probe, point, spare) where the bound allows a link; spare is the bound less the needed overlap."""
        high, least = self.levels[-1]
        probe, box = (a.ravel() for a in np.meshgrid(np.arange(len(sizes)), np.arange(len(least)), indexing="ij"))
        spare = np.zeros(0, np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            high, least = self.levels[level]
            spares = [np.zeros(0, np.int64)]
            for at in range(0, len(probe), 8000):
                p, b = probe[at:at + 8000], box[at:at + 8000]
                shared = np.minimum(vectors[p], high[b])
                bound = shared.sum(axis=1, dtype=np.int64)
                bound[(shared == 255).any(axis=1)] = np.iinfo(np.int32).max
                spares.append(bound - similarity.need(sizes[p], least[b]))
            spare = np.concatenate(spares)
            fit = spare >= 0
            probe, box, spare = probe[fit], box[fit], spare[fit]
            if level:
                below = len(self.levels[level - 1][1])
                probe = np.repeat(probe, FAN)
                box = (box[:, None] * FAN + np.arange(FAN)).ravel()
                probe, box = probe[box < below], box[box < below]
        return probe, self.order[box], spare


def _sets(docs: DataFrame, words: int, similarity: Similarity, id_col: str, text_col: str) -> DataFrame:
    """node, id, n, n_low, d1, d2, vector, low of every document, stored."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                sets = TokenSets.of_texts(part.column("text"), words)
                n_low, low = sets.low(similarity)
                d1, d2 = sets.digests()
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sets.sizes()), pa.array(n_low), pa.array(d1), pa.array(d2),
                     pa.array([v.tobytes() for v in count_vectors(sets)], pa.binary()), low],
                    names=["id", "n", "n_low", "d1", "d2", "vector", "low"])

    made = rows.mapInArrow(run, f"id {kind}, n long, n_low long, d1 long, d2 long, vector binary, low array<bigint>")
    return stored(made.withColumn("node", F.monotonically_increasing_id()), "sets")


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size over hashes of ids; at most FILTER_BITS / 64 rows reach the driver."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    rows = ids.select(F.floor(bit / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int")).alias("mask"))
    found = rows.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found["word"].to_numpy()] = found["mask"].to_numpy()
    return out.view(np.uint64)


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(node, tokens) of the wanted rows (node, id, d1, d2), from a second pass over the texts, stored."""
    kind = docs.schema[id_col].dataType.simpleString()
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))
    spot = F.pmod(F.xxhash64(F.col(id_col)), F.lit(FILTER_BITS))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), spot.alias("spot"))

    def run(batches):
        for batch in batches:
            spots = batch.column("spot").to_numpy()
            some = np.flatnonzero((bits.value[spots >> 6] >> (spots & 63).astype(np.uint64)) & _ONE)
            for at in range(0, len(some), 500):
                part = batch.take(pa.array(some[at:at + 500]))
                sets = TokenSets.of_texts(part.column("text"), words)
                d1, d2 = sets.digests()
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(d1), pa.array(d2), pa.array([sets.set(i).tobytes() for i in range(len(d1))], pa.binary())],
                    names=["id", "d1", "d2", "tokens"])

    made = rows.mapInArrow(run, f"id {kind}, d1 long, d2 long, tokens binary")
    return stored(made.join(wanted, ["id", "d1", "d2"]).dropDuplicates(["node"]).select("node", "tokens"), "tokens")


def verified(pairs: DataFrame, sets: DataFrame, similarity: Similarity) -> DataFrame:
    """The pairs (a, b) whose sets (node, tokens) are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                keep.append(overlap(x, y) >= similarity.need(len(x), len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _leaders(routed: DataFrame, similarity: Similarity) -> DataFrame:
    """(a, b): every node with the leader that most of its keys offer; the leader is the smallest node of like size."""
    band = F.floor(F.log("n") / F.log(F.lit(similarity.den / similarity.num))).alias("band")
    rows = routed.select("key", "node", "n", band)
    lead = stored(rows.groupBy("key", "band").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader < last").drop("last"), "leaders")
    offers = rows.join(lead, ["key", "band"]).filter("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("votes"))
    return offers.groupBy("node").agg(F.max(F.struct("votes", (-F.col("leader")).alias("back"))).alias("best")).select(
        F.col("node").alias("a"), (-F.col("best.back")).alias("b"))


def _tree_pairs(similarity: Similarity, top: int | None):
    """Pairs of rows of a family with different labels whose bound allows a link; of each probe all or the ``top`` best."""

    def meet(rows: pa.Table, probes: pa.Table) -> pa.Table:
        pairs = [np.zeros((0, 2), np.int64)]
        if rows.num_rows and probes.num_rows:
            rows, probes = rows.sort_by("key"), probes.sort_by("key")
            vectors, probe_vectors = matrix(rows["vector"], np.uint8), matrix(probes["vector"], np.uint8)
            r, q = ({c: t[c].to_numpy() for c in ("key", "node", "n", "label")} for t in (rows, probes))
            minor = rows["minor"].to_numpy(zero_copy_only=False)
            keys, starts = np.unique(r["key"], return_index=True)
            ends = np.append(starts[1:], len(minor))
            lo, hi = np.searchsorted(q["key"], keys, "left"), np.searchsorted(q["key"], keys, "right")
            for s, e, first, last in zip(starts, ends, lo, hi):
                tree = CountTree(vectors[s:e], r["n"][s:e]) if first < last else None
                for p in range(first, last, 256):
                    a, b, spare = tree.search(probe_vectors[p:min(last, p + 256)], q["n"][p:min(last, p + 256)], similarity)
                    a, b = a + p, b + s
                    # two minor rows meet twice, as row and as probe
                    fit = (r["label"][b] != q["label"][a]) & (~minor[b] | (q["node"][a] < r["node"][b]) | (top is not None))
                    a, b, spare = a[fit], b[fit], spare[fit]
                    if top is not None:
                        order = np.lexsort((-spare, a))
                        a, b = a[order], b[order]
                        rank = np.arange(len(a)) - np.searchsorted(a, a, "left")
                        a, b = a[rank < top], b[rank < top]
                    pairs.append(np.sort(np.column_stack([q["node"][a], r["node"][b]]), axis=1))
        found = np.unique(np.concatenate(pairs), axis=0)
        return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return meet


def _across(members: DataFrame, labels: DataFrame, vectors: DataFrame, tokens: DataFrame, similarity: Similarity, top: int | None) -> DataFrame:
    """Verified links between members of a family with different labels, stored."""
    labelled = stored(members.join(labels, "node", "left").select("key", "node", F.coalesce("label", F.col("node")).alias("label")), "labelled")
    shares = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    major = shares.groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("top")).filter("labels > 1")
    major = stored(major.select("key", F.col("top.label").alias("major")), "major")
    mixed_rows = labelled.join(major, "key").select("key", "node", "label", (F.col("label") != F.col("major")).alias("minor"))
    base = stored(mixed_rows.join(vectors, "node"), "base")
    pairs = meet_by_key(base, stored(base.filter("minor"), "minor"), _tree_pairs(similarity, top), "a long, b long").distinct()
    return stored(verified(pairs, tokens, similarity), "links")


def link(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles and component_id (the smallest id that links reach), one row per input row."""
    ship(docs.sparkSession)
    similarity = Similarity(num, den)
    sets = _sets(docs, words, similarity, id_col, text_col)
    equal = ["d1", "d2", "n"]
    full = sets.filter("n > 0 AND id IS NOT NULL")
    firsts = stored(full.groupBy(*equal).agg(F.min("node").alias("node")), "firsts")
    prefixes = shared_prefixes(full, firsts, similarity)
    families = stored(prefixes.groupBy("key").agg(F.min("node").alias("family"), F.max("node").alias("last")).filter("family < last").drop("last"), "families")
    routed = stored(prefixes.join(families, "key").select("key", "node", "n", "family"), "routed")

    nodes = routed.select("node").distinct()
    wanted = sets.select("node", "id", "d1", "d2").join(nodes, "node", "left_semi")
    tokens = whole_sets(docs, wanted, words, id_col, text_col)
    stars = stored(verified(_leaders(routed, similarity), tokens, similarity), "stars")
    labels = components(stars)

    members = stored(routed.select(F.col("family").alias("key"), "node").distinct(), "members")
    vectors, links = sets.select("node", "n", "vector"), stars
    for top in (TRIED, None):
        more = _across(members, labels, vectors, tokens, similarity, top)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = components(links)

    # back to all documents: equal sets through their first node, then through the component of that node
    placed = sets.select("node", F.col("id"), *equal).join(firsts.withColumnRenamed("node", "first"), equal, "left")
    placed = placed.withColumn("first", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("first")).otherwise(F.col("node")))
    placed = placed.join(labels.withColumnRenamed("node", "first"), "first", "left").withColumn("label", F.coalesce("label", "first"))
    placed = stored(placed.select("id", F.col("n").alias("n_shingles"), "label"), "placed")
    least = stored(placed.groupBy("label").agg(F.min("id").alias("component_id")), "least")
    return placed.join(least, "label").select(F.col("id").alias(id_col), "n_shingles", "component_id")
