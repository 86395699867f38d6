"""Repaired conversations, against a plain recursion over all edits."""

import functools
import hashlib
import random
import sys
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from salience.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = {}
    for c, t, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        how = zlib.crc32(key.encode()) % 20
        kept = out.setdefault(c, [])
        if how == 1:
            text = ""
        if how == 2:
            text = "".join(x for x in text if x not in ".!?")
        if how == 4:
            role = "user"
        kept += [(t, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def brute(rows):
    """The row of a conversation, from its damaged (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
    faults, seen = [], set()
    for _, role, text in rows:
        body = text.strip(WHITE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    turns = [t for t, _, _ in rows if t is not None]

    sys.setrecursionlimit(20_000)

    @functools.lru_cache(maxsize=None)
    def best(i, q, room):
        """(cost, audit, lines) from row i on, q the roles so far ('', s, u, a), room inserts still allowed here."""
        found = []
        if i == len(rows) and q in ("", "a"):
            found.append((0, "", ()))
        after = "assistant" if q == "u" else "user"
        if room:
            c, a, x = best(i, after[0], room - 1)
            found.append((c + 3, "I" + a, (after + ":", *x)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, x = best(i + 1, q, 3)
            found.append((c + 4, "D" + a, x))
            if faults[i] in ("", "truncated"):
                more = 3 if faults[i] else 0
                if (q, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}:
                    c, a, x = best(i + 1, role[:1], 3)
                    found.append((c + more, "K" + a, (f"{role}:{text}", *x)))
                c, a, x = best(i + 1, after[0], 3)
                found.append((c + 3 + more, "R" + a, (f"{after}:{text}", *x)))
        return min(found, default=(10 ** 9, "", ()))

    cost, audit, lines = best(0, "", 3)
    return ((max(turns) - min(turns) + 1 - len(set(turns))) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "User", "unit"]
    texts = ["Fine.", "Cut off", " \t", "", None, "Really?\n", "é!", "So", "Line\nbreak.", "Fine. \x0b"]
    out = []
    for c in range(150):
        for t in range(rng.randint(1, 9)):
            turn = rng.choice([t, t, t, t, t + 5, None]) if c % 3 else t
            out.append((c, turn, rng.choice(roles[:3] if c % 2 else roles), rng.choice(texts)))
    out += [(1000, t, rng.choice(roles[:4]), rng.choice(texts) if t % 7 else f"Text {t}") for t in range(400)]
    out += [(1001, 3, "user", "Same.")] * 40 + [(1002, None, None, None)] * 3 + [(None, 1, "user", "Hm."), (None, 2, "assistant", "Ok."), (-5, 0, "user", "Hm")]
    dropped = next(c for c in range(2000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return out + [(dropped, 0, "user", "gone.")]


def frame(spark, rows):
    wide = spark.createDataFrame(rows, SCHEMA).withColumn("kind", F.lit(7)).withColumn("slice", F.lit(1)).withColumn("times", F.lit(9)).withColumn("about", F.lit("x"))
    return wide.repartition(4)


def found(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


@pytest.fixture(scope="module")
def want(rows):
    return {c: brute(tuple(x)) for c, x in damaged(rows).items()}


def test_against_recursion(spark, rows, want):
    got = found(repair.digests(repair.damage(frame(spark, rows))))
    assert got == want


def test_conversations_over_many_ranges(spark, rows, want, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK", 300)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "29")
    try:
        damage = repair.damage(frame(spark, rows))
        planned = repair.plans(damage)
        assert planned.filter(F.size("cuts") > 3).count() >= 1
        assert found(repair.digests(damage, planned)) == want
        lines = {}
        for r in repair.repaired(damage, planned).orderBy("slice", "place").collect():
            lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        for c, row in want.items():
            assert hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() == row[-1]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_table(spark, rows):
    assert found(repair.digests(repair.damage(frame(spark, rows).limit(0)))) == {}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("suaoSUAOx", max_size=7), max_size=5), st.integers(0, 3))
def test_walk_shares_suffixes(signatures, near):
    """Costs and audits of a walk that reuses nodes equal those of walks from scratch, wherever whole audits end."""
    path, kept = repair.SuffixPath(), repair.SHARED
    repair.SHARED = near
    try:
        for signs in sorted(s[::-1] for s in signatures):
            path.go(signs)
            one = repair.SuffixPath()
            one.go(signs)
            n = len(signs)
            whole = "".join(a for _, a in path.audit([n]))
            assert path.cost() == one.cost() and whole == one.audit([n])[0][1]
            assert "".join(a for _, a in path.audit([n // 2, 0, n - n // 2])) == whole
            price = {"I": 3, "D": 4, "R": 3, "K": 0}
            rows, left = iter(signs[::-1]), 0
            for letter in whole:
                sign = next(rows) if letter != "I" else ""
                left += price[letter] + (3 if letter in "KR" and sign.isupper() else 0)
            assert left == path.cost()
    finally:
        repair.SHARED = kept
