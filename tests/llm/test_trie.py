"""The trie of rebuilt conversations, against a plain one."""

import collections
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from salience.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, role.encode(), hashlib.md5(text.encode()).digest(), role, text))
    own = {c: [x[4:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members = collections.defaultdict(set)
    ids = {(): ()}  # nodes by (parent, turn), so that long prefixes are not compared
    paths = {}
    for c, turns in convs.items():
        node = 0
        paths[c] = [0]
        for turn in turns:
            node = ids.setdefault((node, turn), len(ids))
            paths[c].append(node)
        for n in paths[c]:
            members[n].add(c)
    parent, chars, depth = {0: None}, {0: 0}, {0: 0}
    for key, node in ids.items():
        if key:
            parent[node], chars[node] = key[0], len(key[1][1])
    order = sorted(n for n in members)
    children, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for n in order:
        if n:
            depth[n] = depth[parent[n]] + 1
            children[parent[n]] += 1
    for n in reversed(order):
        leaves[n] += not children[n]
        saved[n] += (len(members[n]) - 1) * chars[n]
        if n:
            leaves[parent[n]] += leaves[n]
            saved[parent[n]] += saved[n]
    out = []
    for n in order:
        ends = sorted(c for c in members[n] if paths[c][-1] == n)
        out.append((min(members[n]), depth[n], min(members[parent[n]]) if n else None, len(members[n]), children[n], leaves[n], saved[n],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    texts = ["a", "bé", "日本語", "", None, "long " * 30]
    roles = ["user", "assistant", None, ""]
    out = []
    for c in [*range(0, 320, 2), *range(-130, -90), 100_000, 100_007]:
        for t in range(rng.randint(1, 9)):
            out.append((c, rng.choice([t, t, t, None]) if c % 4 == 0 else t, rng.choice(roles[:2] if c % 3 else roles), rng.choice(texts[:2] if c % 5 else texts)))
    out += [(c, t, "user", "same") for c in range(5000, 5060) for t in range(3)]
    for c in (700, 701, 702, 703, 704):  # deep ones that part late
        out += [(c, t, "user", f"deep {t if t < 150 + c % 3 else t * c}") for t in range(230)]
    return out + [(3, 1, "user", "x")] * 5 + [(None, 1, "user", "x"), (9001, None, None, None)]


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)).withColumn("depth", F.lit(1)).withColumn("hash", F.lit("x")).repartition(3)
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256")
    return sorted((tuple(r) for r in trie.prefix_trie(df, **how).select(*columns).collect()), key=repr)


def test_against_plain_trie(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_spread_conversations(spark, rows, monkeypatch):
    """Conversations over many ranges and segments, low bands, small chunks."""
    monkeypatch.setattr(trie, "CHUNK", 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert found(spark, rows, band=8, segment=32) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_few_rows(spark):
    assert found(spark, []) == []
    some = [(c, 0, "user", "x") for c in (1, 2, 3)]
    assert found(spark, some) == brute(some)
