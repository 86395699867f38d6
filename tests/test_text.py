import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from salience.functions import text as tx
from salience.functions import verdict as vd
from salience.functions.matching import lcs_length, union_hits
from salience.functions.stemming import stem
from salience.functions.tdist import t_two_sided


def value(spark, column, **fields):
    row = spark.createDataFrame([tuple(fields.values())], list(fields)) if fields else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_sentences(spark):
    got = value(spark, tx.sentences(F.col("t")), t="  One  two. Three!\nFour? ... five")
    assert got == ["One two.", "Three!", "Four?", "...", "five"]
    assert value(spark, tx.sentences(F.col("t")), t="...") == []
    assert value(spark, tx.sentence_count(F.col("t")), t="a. b.. c") == 3


def test_mask_and_restore(spark):
    s = F.array(F.lit("A b."), F.lit("C."), F.lit("A b."))
    assert value(spark, tx.masked(s, F.lit(1))) == "A b. <mask> A b."
    assert value(spark, tx.unmask(tx.masked(s, F.lit(1)), F.lit("C."))) == "A b. C. A b."
    assert value(spark, tx.other_sentences(s, F.lit(0))) == "C. A b."
    assert value(spark, tx.with_mask_sentence(s, 1)) == "A b. <mask> C. A b."
    assert value(spark, tx.with_mask_sentence(s, 9)) == "A b. C. A b. <mask>"


def test_cut_takes_the_first_occurrence_only(spark):
    assert value(spark, tx.cut_first(F.col("t"), F.col("s")), t="x a y a", s="a") == "x  y a"
    assert value(spark, tx.cut_first(F.col("t"), F.col("s")), t="xyz", s="a") == "xyz"


def test_quotes_and_almost_same(spark):
    assert value(spark, tx.plain_quotes(F.col("t")), t=" “a” – ‘b’\u00ad ") == "\"a\" - 'b'-"
    a, b, c = "x" * 20 + "1", "x" * 20 + "2", "y" + "x" * 20
    assert value(spark, tx.almost_same(F.lit(a), F.lit(b))) is True
    assert value(spark, tx.almost_same(F.lit(a), F.lit(c))) is False


@pytest.mark.parametrize("said, raw, feedback", [
    ("fine [RESULT] A", "A", "fine"), ("fine [RESULT] b, clearly", "B", "fine"), ("fine [RESULT] TIE", "TIE", "fine"),
    ("no tag at all ", "TIE_2", "no tag at all"), ("x [RESULT] A y [RESULT] B", "B", "x  A y"), ("x [RESULT] neither", "TIE", "x"),
    ("[RESULT]", "TIE", ""),
])
def test_verdicts(spark, said, raw, feedback):
    assert value(spark, vd.raw_result(F.col("c")), c=said) == raw
    assert value(spark, vd.feedback(F.col("c")), c=said) == feedback


def test_winner_by_slot(spark):
    got = {(r, f): value(spark, vd.winner(F.lit(r), F.lit(f))) for r in ("A", "B", "TIE_2") for f in (True, False)}
    assert got == {("A", True): "a", ("A", False): "b", ("B", True): "b", ("B", False): "a", ("TIE_2", True): "tie", ("TIE_2", False): "tie"}


def test_prices_and_p_cells(spark):
    assert value(spark, vd.call_price(F.lit(1000), F.lit(500), F.lit(2.0), F.lit(12.0))) == pytest.approx(0.008)
    assert value(spark, vd.call_price(F.lit(1000), F.lit(500), F.lit(None).cast("double"), F.lit(None).cast("double"))) == 0.0
    assert value(spark, vd.p_cell(F.lit(0.02728), F.lit("HIGHER"))) == "0.0273 *(+)"
    assert value(spark, vd.p_cell(F.lit(0.00001234), F.lit("LOWER"))) == "1.23e-05 *(-)"
    assert value(spark, vd.p_cell(F.lit(0.5), F.lit(None).cast("string"))) == "0.5000  (?)"


def naive_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
def test_lcs_against_the_table(a, b):
    assert lcs_length(a, b) == naive_lcs(a, b)


def test_union_of_lines():
    # w1..w5 against two candidate lines covering w1 w2 and w1 w3 w5: four of five words
    ref = [["w1", "w2", "w3", "w4", "w5"]]
    assert union_hits(ref, [["w1", "w2", "w6", "w7", "w8"], ["w1", "w3", "w8", "w9", "w5"]]) == 4
    assert union_hits(ref, []) == 0
    assert union_hits([["a", "a"]], [["a"]]) == 1


@pytest.mark.parametrize("word, want", [
    ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"),
    ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"),
    ("triplicate", "triplic"), ("electricity", "electr"), ("adjustment", "adjust"), ("probate", "probat"), ("controlling", "control"), ("was", "was"),
])
def test_stems(word, want):
    assert stem(word) == want


def test_t_distribution():
    got = t_two_sided([0.0, 2.228138852, 2.2078, 63.656741], [10, 10, 11333, 1])
    assert got[0] == pytest.approx(1.0)
    assert got[1] == pytest.approx(0.05, abs=1e-9)
    assert got[2] == pytest.approx(0.02728, abs=1e-5)
    assert got[3] == pytest.approx(0.01, abs=1e-8)
