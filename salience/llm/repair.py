r"""Conversations brought into the order ``system? (user assistant)+`` by the cheapest edits.

Rows of a conversation are taken by turn, nulls first; rows of one turn by role, then by the md5 of their text. The first
fault of a row counts: blank (only white space), duplicate (role and text seen earlier in the conversation), truncated (the
last other character is not ``.``, ``!`` or ``?``). Keeping a row is free if its role's initial fits, giving it the role user or
assistant costs 3, deleting it 4, inserting an empty user or assistant text 3; blank and duplicate rows must go, and a
truncated row that stays costs 3 more. Of the cheapest edits those with the least sequence of initials D, I, K, R are taken.

*Automaton.* What the edits of a conversation can cost depends only on its signature, one sign per row for role and fault.
Signatures are range-sorted from their ends, so that equal suffixes lie side by side, and each task walks them along one
path: a node is a suffix, and a conversation reuses all nodes that it shares with the one before. A node gets, for each of
the four states of the grammar, the cost-to-go and the best next edits, from the node behind it. Costs less the node's own
minimum take few values, so nodes fall into few profiles, and a profile is computed once. Nodes near the end also keep
the whole best audit for each state.

*Long conversations.* Rows are range-sorted without texts first; a conversation that spreads over several ranges is put
together from one short summary per range. Its texts are then dealt by the same ranges, each with its slice of the audit.
Only the hash of a repaired conversation is sequential: its text passes through one task in chunks. The audit of a
conversation, a letter or more for each row, is one value, as is its signature.

Null roles and texts are one space; a null conversation id is a conversation of its own. A column ``times`` tells how many
equal rows a row stands for; 0 keeps only the conversation, which without rows has zeros and an empty audit. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from salience.llm.graph import stored
from salience.operators.scale import even_join
from salience.session import ship

# Fixed values.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
WHITE = " \t\n\x0b\x0c\r"

#: States of the grammar: nothing yet, after system, after user, after assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAME = {USER: b"user", ASSISTANT: b"assistant"}
#: Nodes this close to the end keep their whole audits.
SHARED = 64
CHUNK = 1 << 20

ABOUT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_KEY = ["turn", "role", "digest"]


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times: rows dropped, emptied, robbed of end marks, repeated or given to the user by a hash."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", word("role").alias("role"), word("text").alias("text"),
        (F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20).alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("how") == 0, 0).when(F.col("how") == 3, 2).otherwise(1).alias("times"))


@lru_cache(maxsize=None)
def _profile(costs: tuple[int, ...], sign: str) -> tuple[int, tuple[int, ...], tuple[tuple[str, int], ...]]:
    """The node before a node with these costs-to-go, for a row of this sign: minimum, costs above it, and per state the
    edits up to and with that row and the state behind it."""
    late = TRUNCATED if sign.isupper() else 0
    kept = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}.get(sign.lower(), {})
    row = []  # per state the edits of the row itself, in the order of their letters: (cost, letter, state behind)
    for q in range(4):
        edits = [(DELETE + costs[q], "D", q)]
        if sign != "x":
            if q in kept:
                edits.append((late + costs[kept[q]], "K", kept[q]))
            edits.append((REROLE + late + costs[_NEXT[q]], "R", _NEXT[q]))
        row.append(edits)
    best = [min(e[0] for e in edits) for edits in row]
    best[USER], best[ASSISTANT] = min(best[USER], INSERT + best[ASSISTANT]), min(best[ASSISTANT], INSERT + best[USER])
    best[EMPTY], best[SYSTEM] = min(best[EMPTY], INSERT + best[USER]), min(best[SYSTEM], INSERT + best[USER])
    steps = []
    for q in range(4):
        letters, at = "", q
        while True:
            cost, letter, behind = next((e for e in row[at] if e[0] == best[at]), (None, "Z", None))
            if letter > "I" and best[at] == INSERT + best[_NEXT[at]]:
                letters, at = letters + "I", _NEXT[at]
                continue
            steps.append((letters + letter, behind))
            break
    low = min(best)
    return low, tuple(b - low for b in best), tuple(steps)


_END = ((0, 2 * INSERT, INSERT, 0), ("", "II", "I", ""))


class SuffixPath:
    """The nodes of one signature, from the end; the next signature keeps those that it shares."""

    def __init__(self):
        self.signs = ""  # from the end
        self.costs, self.least = [_END[0]], [0]
        self.steps: list = [None]
        self.audits = [_END[1]]

    def go(self, signs: str) -> None:
        """Moves to a signature written from its end."""
        n = same = min(len(signs), len(self.signs))
        if signs[:n] != self.signs[:n]:
            same = next(i for i, (a, b) in enumerate(zip(signs, self.signs)) if a != b)
        del self.costs[same + 1:], self.least[same + 1:], self.steps[same + 1:], self.audits[same + 1:]
        for sign in signs[same:]:
            low, costs, steps = _profile(self.costs[-1], sign)
            if len(self.audits) == len(self.costs) <= SHARED:
                behind = self.audits[-1]
                self.audits.append(tuple(letters + behind[q] for letters, q in steps))
            self.least.append(self.least[-1] + low)
            self.costs.append(costs)
            self.steps.append(steps)
        self.signs = signs

    def cost(self) -> int:
        return self.least[-1] + self.costs[-1][EMPTY]

    def audit(self, stops: list[int]) -> list[tuple[int, str]]:
        """The best audit in slices: state before and letters for the first ``stops[0]`` rows, the next ``stops[1]``, ..."""
        out, q, at = [], EMPTY, len(self.signs)
        for i, n in enumerate(stops):
            first, letters, end = q, [], at - n
            shared = len(self.audits) - 1
            while at > end and not (i == len(stops) - 1 and at <= shared):
                edits, q = self.steps[at][q]
                letters.append(edits)
                at -= 1
            if i == len(stops) - 1:
                letters.append(self.audits[at][q])
            out.append((first, "".join(letters)))
        return out


def _narrow(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, times, fault (0 none, 1 truncated, 2 blank)."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    times = F.col("times").cast("int") if "times" in rows.columns else F.lit(1)
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(body == "", 2).when(F.right(body, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    plain = rows.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), times.alias("times"))
    return plain.select("conv_id", "turn", "role", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"), "times", fault.alias("fault"))


def _later(narrow: DataFrame) -> DataFrame:
    """Keys of the rows whose role and text stand in an earlier turn of their conversation."""
    place = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    rows = narrow.filter("times > 0").select(
        F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("none"), "role", "digest", place.alias("place"))
    same = ["c", "none", "role", "digest"]
    firsts = rows.groupBy(*same).agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n"))
    firsts = stored(firsts.filter("first < last").drop("last"), "repeated")
    found = even_join(rows, firsts, same, "n").filter("place > first")
    return found.select(F.when(~F.col("none"), F.col("c")).alias("conv_id"), F.col("place.turn").alias("turn"), "role", "digest")


_RUN = ("conv_id {id}, part int, edge boolean, cut struct<turn:{turn},role:string,digest:binary>, n int, signs string, "
        "turns struct<first:{turn},last:{turn},n:bigint>, initials struct<first:string,last:string>, "
        "faults array<bigint>")


class _Run:
    """One conversation's rows within one sorted range."""

    def __init__(self, conv, key):
        self.conv, self.key, self.part, self.edge = conv, key, TaskContext.get().partitionId(), False
        self.n, self.signs = 0, bytearray()
        self.turns: list = [None, None, 0]
        self.initials: list = [None, None]
        self.faults = [0, 0, 0, 0]  # blank, duplicate, truncated, illegal

    def add(self, turn, role: str, fault: int, repeated: bool, times: int) -> None:
        initial = role[:1]
        if self.n == 0:
            self.initials[0] = initial
        if turn is not None and turn != self.turns[1]:
            self.turns[0] = turn if self.turns[2] == 0 else self.turns[0]
            self.turns[1], self.turns[2] = turn, self.turns[2] + 1
        for _ in range(times):
            if self.n:
                self.faults[3] += self.initials[1] + initial not in ("su", "ua", "au")
            if fault == 2 or repeated:
                self.faults[0 if fault == 2 else 1] += 1
                self.signs.append(120)
            else:
                sign = initial if initial in ("s", "u", "a") else "o"
                self.faults[2] += fault
                self.signs += (sign.upper() if fault else sign).encode()
            self.initials[1] = initial
            self.n, repeated = self.n + 1, True

    def row(self) -> tuple:
        return (self.conv, self.part, self.edge, self.key, self.n, self.signs.decode(), tuple(self.turns), tuple(self.initials), self.faults)


def _runs_of(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Summaries of the runs of sorted rows; the first and the last of a task may go on in another one."""
    run, made, marked, last, first = None, [], None, None, True
    names = schema.names

    def flush():
        columns = list(zip(*made))
        return pa.RecordBatch.from_arrays([_column(c, f.type) for c, f in zip(columns, schema)], names=names)

    for batch in batches:
        for conv, turn, role, digest, kind, fault, times in zip(*(batch.column(c).to_pylist() for c in ("conv_id", *_KEY, "kind", "fault", "times"))):
            key = (turn, role, digest)
            if run is None or run.conv != conv:
                if run is not None:
                    run.edge, first = first, False
                    made.append(run.row())
                    if len(made) == 4096:
                        yield flush()
                        made = []
                run, marked, last = _Run(conv, key), None, None
            if kind == 0:
                marked = key
            elif times:
                run.add(turn, role, fault, key in (marked, last), times)
                last = key
    if run is not None:
        run.edge = True
        made.append(run.row())
        yield flush()


def _column(values: Iterable, kind: pa.DataType) -> pa.Array:
    if pa.types.is_struct(kind):
        return pa.array([dict(zip((f.name for f in kind), v)) for v in values], kind)
    return pa.array(list(values), kind)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _summaries(narrow: DataFrame) -> DataFrame:
    """One row per conversation: its runs in order, summarised."""
    rows = narrow.withColumn("kind", F.lit(1)).unionByName(_later(narrow).withColumn("kind", F.lit(0)), allowMissingColumns=True)
    kinds = {c: narrow.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    ddl = _RUN.format(id=kinds["conv_id"], turn=kinds["turn"])
    schema = _arrow(ddl)
    ranged = rows.repartitionByRange("conv_id", *_KEY).sortWithinPartitions("conv_id", *_KEY, "kind")
    runs = stored(ranged.mapInArrow(lambda batches: _runs_of(batches, schema), ddl), "runs")
    whole = F.struct("part", "cut", "n", "signs", "turns", "initials", "faults")
    inner = runs.filter("NOT edge").select("conv_id", F.array(whole).alias("runs"))
    edges = runs.filter("edge").groupBy("conv_id").agg(F.array_sort(F.collect_list(whole), lambda a, b: a["part"] - b["part"]).alias("runs"))
    return inner.unionByName(edges)


def _about(runs: list[dict]) -> tuple[list[int], str]:
    """gaps, blank, duplicate, truncated, illegal of a conversation, and its signature."""
    faults = [sum(r["faults"][i] for r in runs) for i in range(4)]
    filled = [r for r in runs if r["n"]]
    for a, b in zip(filled, filled[1:]):
        faults[3] += a["initials"]["last"] + b["initials"]["first"] not in ("su", "ua", "au")
    timed = [r["turns"] for r in runs if r["turns"]["n"]]
    gaps = 0
    if timed:
        distinct = sum(t["n"] for t in timed) - sum(a["last"] == b["first"] for a, b in zip(timed, timed[1:]))
        gaps = timed[-1]["last"] - timed[0]["first"] + 1 - distinct
    return [gaps, *faults], "".join(r["signs"] for r in runs)


_PLAN = "conv_id {id}, about struct<{about}>, cuts array<struct<turn:{turn},role:string,digest:binary>>, slices array<struct<state:int,audit:string>>"


def _signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_about(runs) for runs in batch.column("runs").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("runs"), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1][::-1] for f in found], pa.string())],
            names=["conv_id", "runs", "counts", "signs"])


def _planned(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Walks signatures in the order of their ends."""
    path = SuffixPath()
    for batch in batches:
        made = []
        for conv, ns, cuts, counts, signs in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ns", "cuts", "counts", "signs"))):
            path.go(signs)
            slices = path.audit(ns)
            made.append((conv, (*counts, path.cost(), "".join(a for _, a in slices)), cuts[1:], [{"state": q, "audit": a} for q, a in slices]))
        if made:
            yield pa.RecordBatch.from_arrays([_column(c, f.type) for c, f in zip(zip(*made), schema)], names=schema.names)


def plans(rows: DataFrame) -> DataFrame:
    """conv_id, about (counts, cost, audit), cuts (keys where later slices begin) and slices, stored."""
    ship(rows.sparkSession)
    narrow = stored(_narrow(rows).drop("text"), "narrow")
    kinds = {c: narrow.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    summaries = _summaries(narrow)
    runs_type = summaries.schema["runs"].dataType.simpleString()
    signed = summaries.mapInArrow(_signed, f"conv_id {kinds['conv_id']}, runs {runs_type}, counts array<bigint>, signs string")
    signed = stored(signed.select("conv_id", F.transform("runs", lambda r: r["n"]).alias("ns"), F.transform("runs", lambda r: r["cut"]).alias("cuts"), "counts", "signs"), "signatures")
    about = ",".join(x.strip().replace(" ", ":") for x in ABOUT.split(","))
    ddl = _PLAN.format(id=kinds["conv_id"], turn=kinds["turn"], about=about)
    schema = _arrow(ddl)
    walked = signed.repartitionByRange("signs", "conv_id").sortWithinPartitions("signs", "conv_id")
    return stored(walked.mapInArrow(lambda batches: _planned(batches, schema), ddl), "plans")


def _dealt(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows with their texts and, in front of each slice, its audit; sorted, a slice within one partition."""
    heads = planned.select("conv_id", "about", F.size("slices").alias("n_slices"), F.posexplode("slices").alias("slice", "s")).select(
        "conv_id", "slice", F.lit(0).alias("kind"), F.when(F.col("slice") == 0, F.col("about")).alias("about"), "n_slices", "s.state", "s.audit")
    # at most one conversation is cut at each border between two ranges
    cuts = planned.filter(F.size("cuts") > 0).select(F.col("conv_id").alias("cut_id"), "cuts")
    key = F.struct(*_KEY)
    texts = _narrow(rows).filter("times > 0").join(F.broadcast(cuts), F.col("conv_id").eqNullSafe(F.col("cut_id")), "left")
    texts = texts.select("conv_id", F.coalesce(F.size(F.filter("cuts", lambda c: c <= key)), F.lit(0)).alias("slice"), F.lit(1).alias("kind"),
                         *_KEY, "times", F.col("role").cast("binary").alias("name"), F.col("text").cast("binary").alias("text"))
    both = heads.unionByName(texts, allowMissingColumns=True)
    return both.repartition("conv_id", "slice").sortWithinPartitions("conv_id", "slice", "kind", *_KEY)


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[bytes, bytes]]]]:
    """Slices in order: the row in front, and the repaired rows (role, text) of the slice, to be read to their end."""

    def rows():
        names = ("conv_id", "slice", "kind", "n_slices", "state", "audit", "about", "times", "name", "text")
        for batch in batches:
            yield from (dict(zip(names, r)) for r in zip(*(batch.column(c).to_pylist() for c in names)))

    def edit(head: dict, texts: Iterator[dict]):
        state, row, left = head["state"], None, 0
        for letter in head["audit"]:
            if letter != "I" and not left:
                row = next(texts)
                left = row["times"]
            if letter == "I":
                state = _NEXT[state]
                yield _NAME[state], b""
                continue
            left -= 1
            if letter == "K":
                state = SYSTEM if row["name"][:1] == b"s" else _NEXT[state]
                yield row["name"], row["text"]
            elif letter == "R":
                state = _NEXT[state]
                yield _NAME[state], row["text"]

    for _, group in itertools.groupby(rows(), lambda r: (r["conv_id"], r["slice"])):
        head = next(group)
        edits = edit(head, group)
        yield head, edits
        for _ in edits:  # what the caller has not read
            pass


def repaired(rows: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """conv_id, slice, place, role, text: the repaired conversations; place counts within a slice."""
    planned = plans(rows) if planned is None else planned
    ddl = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, slice int, place long, role string, text string"
    schema = _arrow(ddl)

    def run(batches):
        for head, edits in _edited(batches):
            made = ((head["conv_id"], head["slice"], i, r.decode(), t.decode()) for i, (r, t) in enumerate(edits))
            while some := list(itertools.islice(made, 512)):
                yield pa.RecordBatch.from_arrays([_column(c, f.type) for c, f in zip(zip(*some), schema)], names=schema.names)

    return _dealt(rows, planned).mapInArrow(run, ddl)


def digests(rows: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """conv_id, the counts, cost and audit, and the sha256 of the repaired ``role:text`` lines."""
    planned = plans(rows) if planned is None else planned
    kind = rows.schema["conv_id"].dataType.simpleString()
    about = planned.schema["about"].dataType.simpleString()
    ddl = f"conv_id {kind}, slice int, n int, about {about}, sha string, chunk binary"
    schema = _arrow(ddl)

    def run(batches):
        made = []
        for head, edits in _edited(batches):
            first = head["state"] == EMPTY
            lines = (r + b":" + t for r, t in edits)
            if head["n_slices"] == 1:
                sha = hashlib.sha256()
                for i, line in enumerate(lines):
                    sha.update(b"\n" + line if i else line)
                made.append((head["conv_id"], 0, 0, head["about"], sha.hexdigest(), None))
            else:  # another task goes on: the bytes in chunks
                n, chunk, sent = 0, bytearray(), False
                for i, line in enumerate(lines):
                    chunk += line if first and not i else b"\n" + line
                    if len(chunk) >= CHUNK:
                        yield batch_of([(head["conv_id"], head["slice"], n, head["about"] if not sent else None, None, bytes(chunk))])
                        n, chunk, sent = n + 1, bytearray(), True
                made.append((head["conv_id"], head["slice"], n, head["about"] if not sent else None, None, bytes(chunk)))
            if len(made) == 2048:
                yield batch_of(made)
                made = []
        if made:
            yield batch_of(made)

    def batch_of(made):
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*made), schema)], names=schema.names)

    def join(batches):
        conv, about, sha, some = None, None, None, False
        for batch in batches:
            for r in batch.to_pylist():
                if not some or r["conv_id"] != conv:
                    if some:
                        yield batch_of([(conv, 0, 0, about, sha.hexdigest(), None)])
                    conv, about, sha, some = r["conv_id"], r["about"], hashlib.sha256(), True
                sha.update(r["chunk"])
        if some:
            yield batch_of([(conv, 0, 0, about, sha.hexdigest(), None)])

    found = _dealt(rows, planned).mapInArrow(run, ddl)
    if not planned.filter(F.size("cuts") > 0).isEmpty():
        found = stored(found, "chunks")
        cut = found.filter("sha IS NULL").repartition("conv_id").sortWithinPartitions("conv_id", "slice", "n").mapInArrow(join, ddl)
        found = found.filter("sha IS NOT NULL").unionByName(cut)
    return found.select("conv_id", "about.*", F.col("sha").alias("repaired_sha256"))
