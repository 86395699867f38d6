import pytest
from pyspark.sql import functions as F

from salience.functions import entities as en
from salience.operators import entities as ops
from salience.schemas import ENTITIES, TOKENS

SCHEMA = f"doc_id LONG, document STRING, summary STRING, summary_ents {ENTITIES}, document_ents {ENTITIES}, summary_tokens {TOKENS}"


def ent(text, start, ids, kind="PERSON"):
    return (text, start, start + len(text), kind, text.split(" "), ids)


def toks(rows, text):
    """(word, dep, head, children, blank after)"""
    out, at = [], 0
    for i, (w, dep, head, children) in enumerate(rows):
        ws = " " if text[at + len(w):at + len(w) + 1] == " " else ""
        out.append((w, i, at, dep, head, children, "", "", ws))
        at += len(w) + len(ws)
    return out


def run(spark, summary, ents, doc_ents, tokens, mode="all", lowercase=False):
    df = spark.createDataFrame([(1, "", summary, ents, doc_ents, tokens)], SCHEMA)
    return ops.corrected(df, mode, lowercase).first()


def test_spans():
    text = "In 1999 Anna Lee paid $5.20, or 12%, to Bo."
    got = en.spans(text, True)
    assert [(r["text"], r["ent_type"]) for r in got] == [
        ("In", "GPE"), ("1999", "DATE"), ("Anna Lee", "PERSON"), ("$5.20", "MONEY"), ("12%", "PERCENT"), ("Bo", "GPE")]
    assert all(text[r["start_idx"]:r["end_idx"]] == r["text"] for r in got)
    assert got[2]["i"] == [2, 3] and got[2]["tokens"] == ["Anna", "Lee"]


def test_supported_entities_stay(spark):
    text = "anna met Bo"
    tokens = toks([("anna", "nsubj", 1, []), ("met", "ROOT", 1, [0, 2]), ("Bo", "dobj", 1, [])], text)
    got = run(spark, text, [ent("anna", 0, [0]), ent("Bo", 9, [2])], [ent("anna lee", 0, [0, 1]), ent("Bo", 10, [2])], tokens)
    assert got["summary"] == "Anna met Bo" and got["corrected"] == 1
    same = run(spark, text, [ent("anna", 0, [0])], [ent("anna lee", 0, [0, 1])], tokens, lowercase=True)
    assert same["summary"] == text and same["corrected"] == 0


def test_replacement_shifts_later_offsets(spark):
    text = "Dr Anna Lee met Bo Ray Jr today"
    tokens = toks([("Dr", "compound", 2, []), ("Anna", "compound", 2, []), ("Lee", "nsubj", 3, [0, 1]), ("met", "ROOT", 3, [2, 6, 7]),
                   ("Bo", "compound", 6, []), ("Ray", "compound", 6, []), ("Jr", "dobj", 3, [4, 5]), ("today", "npadvmod", 3, [])], text)
    ents = [ent("Dr Anna Lee", 0, [0, 1, 2]), ent("Bo Ray Jr", 16, [4, 5, 6]), ent("today", 26, [7], "DATE")]
    docs = [ent("Anna Lee", 0, [0, 1]), ent("Lee", 20, [9]), ent("Ray Jr", 40, [12, 13]), ent("today", 50, [15], "DATE")]
    got = run(spark, text, ents, docs, tokens, "replace")
    assert got["summary"] == "Anna Lee met Ray Jr today" and got["corrected"] == 0
    assert [(e["text"], e["start_idx"], e["end_idx"]) for e in got["summary_ents"]] == [("Anna Lee", 0, 8), ("Ray Jr", 13, 19), ("today", 20, 25)]
    assert {t["i"]: t["idx"] for t in got["summary_tokens"]}[7] == 20
    assert [t["dep"] for t in got["summary_tokens"]][:4] == ["fixed", "fixed", "fixed", "ROOT"]


def test_removal_takes_children_and_empty_links(spark):
    text = "they moved to the Paris of Mars today"
    tokens = toks([("they", "nsubj", 1, []), ("moved", "ROOT", 1, [0, 2, 7]), ("to", "prep", 1, [4]), ("the", "det", 4, []), ("Paris", "pobj", 2, [3, 5]),
                   ("of", "prep", 4, [6]), ("Mars", "pobj", 5, []), ("today", "npadvmod", 1, [])], text)
    got = run(spark, text, [ent("Mars", 27, [6]), ent("today", 32, [7], "DATE")], [ent("today", 0, [0], "DATE")], tokens, "remove")
    # "of" goes with "Mars"; "Paris" still carries "the", so the climb ends there
    assert got["summary"] == "They moved to the Paris today" and got["corrected"] == 1
    assert [(e["text"], e["start_idx"]) for e in got["summary_ents"]] == [("today", 24)]
    both = run(spark, text, [ent("Paris", 18, [4]), ent("Mars", 27, [6]), ent("today", 32, [7], "DATE")], [ent("today", 0, [0], "DATE")], tokens, "remove")
    assert both["summary"] == "They moved today"
    assert [(e["text"], e["start_idx"], e["end_idx"]) for e in both["summary_ents"]] == [("today", 11, 16)]


def test_kept_children_and_lower_case(spark):
    text = "big Acme rose"
    tokens = toks([("big", "compound", 1, []), ("Acme", "nsubj", 2, [0]), ("rose", "ROOT", 2, [1])], text)
    got = run(spark, text, [ent("Acme", 4, [1], "ORG")], [], tokens, "all", lowercase=True)
    assert got["summary"] == "big rose"
    gone = run(spark, "Acme", [ent("Acme", 0, [0], "ORG")], [], toks([("Acme", "ROOT", 0, [])], "Acme"))
    assert gone["summary"] == "" and gone["summary_ents"] == []


def test_entity_ends_the_text_and_neighbours(spark):
    text = "X Y"
    tokens = toks([("X", "ROOT", 0, [1]), ("Y", "compound", 0, [])], text)
    got = run(spark, text, [ent("X", 0, [0]), ent("Y", 2, [1])], [ent("Y", 5, [3])], tokens)
    assert got["summary"] == "Y" and [(e["text"], e["start_idx"]) for e in got["summary_ents"]] == [("Y", 0)]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        run(spark, "a", [], [], [], mode="none")


def rows(spark):
    mk = lambda d, s, se, de: (d, "", s, se, de, [])
    return spark.createDataFrame([
        mk(1, "Anna left", [ent("Anna", 0, [0])], [ent("Anna", 0, [0]), ent("Boris", 9, [1]), ent("1999", 20, [3], "DATE")]),
        mk(2, "Cleo left", [ent("Cleo", 0, [0])], [ent("Cleo", 0, [0])]),
        mk(3, "Nobody", [], []),
        mk(4, "in 1999 Dan", [ent("1999", 3, [1], "DATE"), ent("Zed", 8, [2])], [ent("1999", 0, [0], "DATE"), ent("2001", 5, [1], "DATE")]),
    ], SCHEMA)


def test_intrinsic_negatives(spark):
    got = {(r["doc_id"], r["r"]): r["negative"] for r in ops.intrinsic_negatives(rows(spark), 2).collect()}
    # document 2 has no other word, 3 no entity; every negative swaps in the one other word of the category
    assert got == {(1, 0): "Boris left", (1, 1): "Boris left", (4, 0): "in 2001 Dan", (4, 1): "in 2001 Dan"}


@pytest.mark.parametrize("small", [1000, 0])
def test_extrinsic_negatives(spark, monkeypatch, small):
    """The same negatives whether pools are read in the row or joined."""
    monkeypatch.setattr(ops, "SMALL_POOL", 1000)
    want = sorted(map(tuple, ops.extrinsic_negatives(rows(spark), 1).collect()))
    monkeypatch.setattr(ops, "SMALL_POOL", small)
    got = sorted(map(tuple, ops.extrinsic_negatives(rows(spark), 1).collect()))
    assert got == want
    for doc, _, negative in got:
        assert doc in (1, 2) and negative.endswith(" left")
        assert not {1: ("Anna", "Boris", "1999"), 2: ("Cleo",)}[doc][0] in negative


def test_categories(spark):
    got = spark.createDataFrame([("MONEY",), ("TIME",), ("LAW",), ("ORG",)], "t STRING").select(en.category(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in got] == ["number", "date", "entity", "entity"]


def test_replaceable_kinds(spark):
    """Kinds that some pool word could replace, against a scan of the pool for each."""
    pool = {"entity": ["Paris", "Parish", "Mars", "a", "Arsenal", "marsh"], "date": ["2001", "1999"]}
    kinds = [("entity", ["a"]), ("entity", ["Par", "ars"]), ("entity", ["a", "A", "M"]), ("entity", ["Rome"]), ("entity", ["Rome", "Rome"]), ("date", ["9", "2"]),
             ("date", ["0", "1"]), ("date", ["2001"]), ("number", ["1"]), ("entity", ["a", "rs"]), ("entity", ["s", "P"])]
    words = spark.createDataFrame([(c, w) for c, ws in pool.items() for w in ws], "category string, word string")
    sizes = words.groupBy("category").count().withColumnRenamed("count", "n")
    got = {(r["category"], tuple(r["tokens"])) for r in ops.replaceable(spark.createDataFrame(kinds, "category string, tokens array<string>"), words, sizes).collect()}
    assert got == {(c, tuple(sorted(set(t)))) for c, t in kinds if any(all(x not in w for x in t) for w in pool.get(c, []))}
