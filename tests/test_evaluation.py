import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from salience.operators import checks, corrections, evaluate, human, judge, length
from salience.sources import packets, reports
from salience.sources import tables as src
from salience.streaming.judging import continue_run, judge_arrivals, results_so_far


def preds(spark):
    rows = [
        (1, "en", "s1", "the cat sat on the mat", "the cat sat", "a dog ran"), (2, "en", "s1", "one two three", "one two three", "one two"),
        (3, "de", "s1", "x y", "q", "r"), (4, "de", "s2", "", "a", ""), (5, "en", "s2", "alpha beta gamma delta", "beta", "alpha beta gamma"),
    ]
    return spark.createDataFrame(rows, "doc_id LONG, dataset STRING, checkpoint STRING, reference STRING, summary_a STRING, summary_b STRING")


def test_overlap_scores(spark):
    got = {(r["doc_id"], r["metric"]): (r["a"], r["b"]) for r in evaluate.paired_scores(preds(spark)).collect()}
    assert got[1, "rouge1"] == pytest.approx((2 * 3 / 9, 0.0))
    assert got[1, "precision1"] == pytest.approx((1.0, 0.0))
    assert got[1, "recall2"] == pytest.approx((2 / 5, 0.0))
    assert got[2, "rouge2"] == pytest.approx((1.0, 2 * 1 / 3))
    assert got[4, "rouge1"] == (0.0, 0.0)


def test_stems_count_as_equal(spark):
    df = spark.createDataFrame([(1, "d", "c", "running dogs", "run dog", "cat")], preds(spark).schema)
    assert {r["metric"]: r["a"] for r in evaluate.paired_scores(df, use_stems=True).collect()}["rouge1"] == 1.0
    assert evaluate.subsequence_scores(df).first()["a"] == 1.0


def paired(spark, rows):
    return spark.createDataFrame([(i, "d", "c", "m", float(a), float(b)) for i, (a, b) in enumerate(rows)],
                                 "doc_id LONG, dataset STRING, checkpoint STRING, metric STRING, a DOUBLE, b DOUBLE")


def test_paired_t(spark):
    t = evaluate.with_p(evaluate.paired_t(paired(spark, [(1, 0), (2, 1.5), (3, 1), (0, 0)]))).first()
    d = [1, 0.5, 2]
    m = sum(d) / 3
    sd = math.sqrt(sum((x - m) ** 2 for x in d) / 2)
    assert t["n"] == 3 and t["t"] == pytest.approx(m / (sd / math.sqrt(3)), abs=1e-6) and t["direction"] == "HIGHER"
    assert 0.05 < t["p_raw"] < 0.2 and t["significant"] is False
    flat = evaluate.with_p(evaluate.paired_t(paired(spark, [(2, 1), (3, 2)]))).first()
    assert flat["t"] is None and flat["p_raw"] is None and flat["direction"] is None


def adjust(ps):
    m = len(ps)
    order = sorted(range(m), key=lambda i: ps[i])
    holm, bh, top, low = [0.0] * m, [0.0] * m, 0.0, 1.0
    for k, i in enumerate(order):
        top = max(top, (m - k) * ps[i])
        holm[i] = min(1.0, top)
    for k in reversed(range(m)):
        low = min(low, ps[order[k]] * m / (k + 1))
        bh[order[k]] = low
    return holm, bh


def test_corrections(spark):
    ps = [0.001, 0.04, 0.03, 0.03, 0.9, 0.2, 0.0004]
    df = spark.createDataFrame([("d", f"m{i}", "c", p, "HIGHER" if i % 2 else "LOWER") for i, p in enumerate(ps)],
                               "dataset STRING, metric STRING, checkpoint STRING, p_raw DOUBLE, direction STRING")
    got = {r["metric"]: r for r in corrections.corrected(df).collect()}
    holm, bh = adjust(ps)
    for i in range(len(ps)):
        assert got[f"m{i}"]["p_holm"] == pytest.approx(holm[i]) and got[f"m{i}"]["p_bh"] == pytest.approx(bh[i])
        assert got[f"m{i}"]["p_bh"] <= got[f"m{i}"]["p_holm"] + 1e-12
    assert [r["metric"] for r in corrections.lost_significance(corrections.corrected(df)).collect()] == [
        f"m{i}" for i in range(7) if ps[i] < 0.05 <= bh[i]]
    total = corrections.tally(corrections.corrected(df)).filter("dataset = 'TOTAL'").first()
    assert total["tests"] == 7 and total["raw_wins"] + total["raw_losses"] == 5


def test_dominance_and_agreement(spark):
    names = evaluate.OVERLAP_METRICS
    rows = [(1, "d", "c", m, 1.0, 0.0) for m in names] + [(2, "d", "c", m, 0.0, 1.0 if k < 4 else 0.0) for k, m in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id LONG, dataset STRING, checkpoint STRING, metric STRING, a DOUBLE, b DOUBLE")
    v = spark.createDataFrame([(1, "tie"), (2, "a")], "doc_id LONG, winner STRING")
    got = evaluate.dominance(df, v).first()
    assert (got["a_dominates"], got["b_dominates"], got["judge_tie_metrics_a"], got["judge_a_metrics_b"]) == (1, 1, 1, 1)
    both = evaluate.both_agree(df, "rouge1", "rouge2").first()
    assert (both["both_a"], both["both_b"]) == (1, 1)


def test_consensus_is_null_without_decisions(spark):
    rows = [("d", "c", "tie", True, "tie", "tie"), ("d", "c", "tie", False, "a", "b"), ("d", "k", "a", True, "a", "a"), ("d", "k", "tie", False, "a", "b"), ("d", "k", "tie", True, "tie", "tie")]
    df = spark.createDataFrame(rows, "dataset STRING, checkpoint STRING, winner STRING, orders_agree BOOLEAN, winner_a_as_A STRING, winner_a_as_B STRING")
    got = {r["checkpoint"]: r for r in judge.consensus_stats(df, ["dataset", "checkpoint"]).collect()}
    assert got["c"]["rate"] is None and got["c"]["disagreed"] == 1
    assert got["k"]["rate"] == 1.0 and got["k"]["both_tie"] == 1 and got["k"]["advantage"] == 0.5
    assert got["k"]["advantage_half_ci"] == pytest.approx(1.96 * math.sqrt(0.25 / 2), abs=1e-6)


def bins_by_hand(deltas, target=20, least=30):
    """Quantile cuts, then merging, written down as a loop over single values."""
    xs = sorted(deltas)
    n = len(xs)
    cuts = sorted({xs[min(n * k // target, n - 1)] for k in range(1, target)})
    groups = defaultdict(int)
    for x in xs:
        groups[max([c for c in cuts if c <= x], default=-10**9)] += 1
    out, lo, c = [], None, 0
    for g in sorted(groups):
        lo = g if lo is None else lo
        c += groups[g]
        if c >= least:
            out.append([lo, c])
            lo, c = None, 0
    if lo is not None:
        if out:
            out[-1][1] += c
        else:
            out = [[lo, c]]
    out[0][0] = -10**9
    return [(a, (out[i + 1][0] - 1 if i + 1 < len(out) else 10**9), c) for i, (a, c) in enumerate(out)]


@pytest.mark.parametrize("deltas", [
    [0] * 200 + list(range(-50, 50)), [(i * i) % 37 - 18 for i in range(500)], [1, 2, 3], [5] * 10 + [6] * 31 + [7] * 5])
def test_length_bins(spark, deltas):
    df = spark.createDataFrame([("d", "c", 100 + d, 100, "a" if d % 2 else "tie") for d in deltas], "dataset STRING, checkpoint STRING, words_a LONG, words_b LONG, winner STRING")
    got = length.quantile_bins(length.histogram(df)).orderBy("j").collect()
    assert [(r["lo"], r["hi"], r["weight"]) for r in got] == bins_by_hand(deltas)


def test_standardized_rate(spark):
    rows = [("d", "src1", 10, 10, "a")] * 6 + [("d", "src1", 10, 10, "b")] * 4 + [("d", "src2", 20, 10, "a")] * 5 + [("d", "src2", 20, 10, "b")] * 15
    df = length.histogram(spark.createDataFrame(rows, "dataset STRING, checkpoint STRING, words_a LONG, words_b LONG, winner STRING"))
    bins = spark.createDataFrame([("d", 0, -10**9, 4, 10), ("d", 1, 5, 10**9, 20)], "dataset STRING, j LONG, lo LONG, hi LONG, weight LONG")
    got = {r["checkpoint"]: r for r in length.standardized_rates(df, bins, 3).collect()}
    assert got["src1"]["rate"] == pytest.approx(0.6) and got["src1"]["var"] == pytest.approx(0.6 * 0.4 / 10)
    raw = length.raw_rates(df).withColumn("step", F.substring("checkpoint", 4, 9).cast("long"))
    change = length.first_to_last(raw).first()
    assert change["change"] == pytest.approx(-35.0) and change["half_ci"] == pytest.approx(1.96 * math.sqrt(0.024 + 0.25 * 0.75 / 20) * 100, abs=1e-5)


def test_trend(spark):
    ys = [0.5, 0.52, 0.51, 0.56]
    df = spark.createDataFrame([("d", i + 1, y) for i, y in enumerate(ys)], "dataset STRING, step LONG, rate DOUBLE")
    xs = [1, 2, 3, 4]
    mx, my = 2.5, sum(ys) * 25
    slope = sum((x - mx) * (100 * y - my) for x, y in zip(xs, ys)) / 5
    rest = sum((100 * y - (my + slope * (x - mx))) ** 2 for x, y in zip(xs, ys))
    got = length.trend(df).first()
    assert got["slope"] == pytest.approx(slope, abs=1e-6) and got["half_ci"] == pytest.approx(2.447 * math.sqrt(rest / 2 / 5), abs=1e-5)


def kappa_by_hand(pairs):
    n = len(pairs)
    a, b = Counter(x for x, _ in pairs), Counter(y for _, y in pairs)
    e = sum(a[c] * b[c] for c in a) / n / n
    return None if e >= 1 else (sum(x == y for x, y in pairs) / n - e) / (1 - e)


def tau_by_hand(pairs):
    s = nx = ny = 0
    for i in range(len(pairs)):
        for j in range(i):
            dx, dy = pairs[i][0] - pairs[j][0], pairs[i][1] - pairs[j][1]
            s += (dx * dy > 0) - (dx * dy < 0)
            nx += dx != 0
            ny += dy != 0
    return None if nx * ny == 0 else s / math.sqrt(nx * ny)


@pytest.mark.parametrize("pairs", [
    [("a", "a"), ("b", "tie"), ("tie", "tie"), ("a", "b"), ("b", "b"), ("a", "a")], [("a", "a")] * 4, [("a", "b"), ("b", "a"), ("tie", "a")]])
def test_kappa_and_tau(spark, pairs):
    df = spark.createDataFrame([(i, "q", "d", "A", "A", x, y) for i, (x, y) in enumerate(pairs)], "item LONG, dimension STRING, dataset STRING, human_slot STRING, judge_slot STRING, human STRING, judge STRING")
    got = human.agreement(df).filter("dataset = 'ALL'").first()
    rank = {"a": 1, "tie": 0, "b": -1}
    k, t = kappa_by_hand(pairs), tau_by_hand([(rank[x], rank[y]) for x, y in pairs])
    assert got["kappa"] == (None if k is None else pytest.approx(k, abs=1e-6))
    assert got["tau_b"] == (None if t is None else pytest.approx(t, abs=1e-6))


def test_majority_and_panel(spark):
    rows = [(1, "x", "A"), (1, "y", "A"), (1, "z", "B"), (2, "x", "A"), (2, "y", "B"), (2, "z", "tie"), (3, "x", "tie")]
    votes = spark.createDataFrame([(i, a, "q", v) for i, a, v in rows], "item LONG, annotator STRING, dimension STRING, vote STRING")
    assert {r["item"]: r["vote"] for r in human.majority(votes).collect()} == {1: "A", 2: None, 3: "tie"}
    got = human.panel_agreement(votes).first()
    ks = [kappa_by_hand(p) for p in ([("A", "A"), ("A", "B")], [("A", "B"), ("A", "tie")], [("A", "B"), ("B", "tie")])]
    ks = [k for k in ks if k is not None]
    assert got["agreement"] == pytest.approx(1 / 6, abs=1e-6) and got["kappa"] == pytest.approx(sum(ks) / len(ks), abs=1e-6) and got["raters"] == 3


def test_vote_table(spark, tmp_path):
    (tmp_path / "v.csv").write_text("Informativeness, ITEM ,faithfulness\nA,1,TIE\n,2,b\nt,,A\nmaybe,x,a\n")
    cells = packets.read_vote_cells(spark, str(tmp_path / "v.csv"))
    bad = {(r["dimension"], r["problem"]) for r in packets.vote_violations(cells).collect()}
    assert bad == {("informativeness", "item"), ("faithfulness", "item")}
    good = {(r["item"], r["dimension"], r["annotator"], r["vote"]) for r in packets.votes_from(cells.filter("item <> 'x'")).collect()}
    assert good == {(1, "informativeness", "annotator_1", "A"), (1, "faithfulness", "annotator_1", "tie"), (2, "faithfulness", "annotator_1", "B")}
    (tmp_path / "w.csv").write_text("a,b\n1,2\n")
    with pytest.raises(checks.DataError):
        packets.read_vote_cells(spark, str(tmp_path / "w.csv"))


def test_packet_and_key(spark, tmp_path):
    rule = "-" * 80
    item = lambda n, a: f"ITEM {n}\n{rule}\nSOURCE DOCUMENT:\nlong\ntext {n}\n\nREFERENCE SUMMARY:\nref\n\nCANDIDATE A:\n{a}\n\nCANDIDATE B:\nbee\n\nBEST ACCORDING TO\n"
    (tmp_path / "p.txt").write_text("Instructions\n\n" + item(1, "x") + item(12, "y z"))
    rows = {r["item"]: r for r in packets.read_packets(spark, str(tmp_path / "p.txt")).collect()}
    assert rows[1]["document"] == "long\ntext 1" and rows[12]["candidate_a"] == "y z" and rows[12]["candidate_b"] == "bee"
    (tmp_path / "k.txt").write_text("key\n    1      4  news          88  b             a\n   12      4  news          97  a             a\nend\n")
    key = packets.read_answer_key(spark, str(tmp_path / "k.txt"))
    assert key.count() == 2
    with pytest.raises(checks.DataError):
        packets.joined_items(packets.read_packets(spark, str(tmp_path / "p.txt")), key)


def test_reports(spark, tmp_path):
    text = ("Paired t-test statistic for <x> dataset for 'r1' metric between both models: 2.2\n"
            "Paired t-test p-value for <x> dataset for 'r1' metric between both models: 0.027\n--> The first model (P) mean is HIGHER than the second model (R) for <x> dataset.\n"
            "Paired t-test p-value for <x> dataset for 'r2' metric between both models: 1.5e-07\n--> The first model (P) mean is LOWER than the second model (R) for <y> dataset.\n")
    (tmp_path / "results-3M pt-final.txt").write_text(text)
    got = sorted((r["metric"], r["checkpoint"], r["p_raw"], r["direction"], r["mismatch"]) for r in reports.read_reports(spark, str(tmp_path)).collect())
    assert got == [("r1", "3M", 0.027, "HIGHER", False), ("r2", "3M", 1.5e-07, None, False)]


def test_truncated_lines_and_missing_split(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"k": 1, "v": "a"}\n{"k": 2, "v": "b"}\n{"k": 3, "v": "c')
    assert [r["k"] for r in src.read_record_lines(spark, str(tmp_path / "p.jsonl"), "k LONG, v STRING").collect()] == [1, 2]
    (tmp_path / "a.json").write_text('[{"k": 1}, {"k": 2}]')
    assert src.read_record_array(spark, str(tmp_path / "a.json"), "k LONG").count() == 2
    src.write_splits(spark.range(3).withColumn("split", F.lit("train")), str(tmp_path / "s"))
    with pytest.raises(checks.DataError, match="train"):
        src.read_split(spark, str(tmp_path / "s"), "test")


def test_lines_keep_their_order(spark, tmp_path):
    df = spark.range(500).select((F.col("id") * 3).alias("k"), F.concat(F.lit(" line\n"), F.col("id").cast("string")).alias("t")).repartition(7)
    src.write_lines(df, str(tmp_path / "l"), "k", "t")
    got = {r["line"]: r["value"] for r in src.read_lines(spark, str(tmp_path / "l")).collect()}
    assert got == {i: f"line {i}" for i in range(500)}
    with pytest.raises(Exception, match="no row for line"):
        src.align_lines(spark.range(3).withColumnRenamed("id", "idx"), src.read_lines(spark, str(tmp_path / "l")), "idx", "p").collect()
    with pytest.raises(Exception, match="no line for row"):
        src.align_lines(spark.range(501).withColumnRenamed("id", "idx"), src.read_lines(spark, str(tmp_path / "l")), "idx", "p").collect()


def in_small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)


@pytest.fixture
def small_splits(spark):
    yield lambda size: in_small_splits(spark, size)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_of_one_file_are_numbered_across_splits(spark, tmp_path, small_splits):
    (tmp_path / "a.txt").write_text("\n".join(f"a{i}" + "x" * (i % 50) for i in range(300)) + "\n")
    (tmp_path / "b.txt").write_text("b0\n\nb2\n")
    small_splits(700)
    rows = src.read_records(spark, str(tmp_path))
    assert rows.select("file", "split").distinct().count() > 5
    got = {r["line"]: r["value"] for r in src.read_lines(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate([f"a{i}" + "x" * (i % 50) for i in range(300)] + ["b0", "", "b2"]))


def test_packets_of_one_file_across_splits(spark, tmp_path, small_splits):
    rule = "-" * 80
    body = {n: "text\n" * (n % 40) + ("ITEM of a list\nITEM 5\nno rule\n" * 30 if n % 7 == 0 else "") + f"end {n}" for n in range(1, 90)}
    items = [f"ITEM {n}\n{rule}\nSOURCE DOCUMENT:\n{body[n]}\n\nREFERENCE SUMMARY:\nr{n}\n\nCANDIDATE A:\na\n\nCANDIDATE B:\nb\n\nYOUR CHOICE: [ ]\n" for n in body]
    (tmp_path / "p.txt").write_text("Read this.\nITEM by item\n\n" + "\n".join(items))
    small_splits(500)
    assert src.read_records(spark, str(tmp_path / "p.txt"), packets.NEXT_ITEM).select("split").distinct().count() > 20
    rows = packets.read_packets(spark, str(tmp_path / "p.txt")).collect()
    assert {r["item"]: (r["document"], r["reference"], r["candidate_b"]) for r in rows} == {n: (body[n], f"r{n}", "b") for n in body} and len(rows) == 89
    (tmp_path / "q.txt").write_text(items[0] + "\n" + items[1].replace("CANDIDATE A:", "CANDIDATE X:"))
    with pytest.raises(Exception, match="item 2 has no"):
        packets.read_packets(spark, str(tmp_path / "q.txt")).collect()


def test_packets_written_hold_few_items(spark, tmp_path):
    items = spark.range(230).select(F.col("id").alias("item"), *[F.concat(F.lit(c), F.col("id").cast("string")).alias(c) for c in ("document", "reference", "candidate_a", "candidate_b")])
    packets.write_packets(items.repartition(3), str(tmp_path / "p"))
    files = sorted((tmp_path / "p").glob("part-*"))
    counts = [f.read_text().count("YOUR CHOICE") for f in files]
    assert sum(counts) == 230 and max(counts) <= 50 and not list((tmp_path / "p").glob("*="))
    assert sorted(packets.read_packets(spark, str(tmp_path / "p")).collect()) == sorted(items.collect())


def test_pairs_of_a_large_panel(spark):
    votes = [(i, "d", f"w{k:03d}", "A" if (k * 7 + i) % 3 else "B") for i in range(3) for k in range(40 + 30 * i)] + [(9, "d", "w000", "tie")]
    want = Counter()
    for i in range(3):
        ballot = [(a, v) for item, _, a, v in votes if item == i]
        want.update((a, b, x, y) for k, (a, x) in enumerate(ballot) for b, y in ballot[k + 1:])
    df = spark.createDataFrame(votes, "item LONG, dimension STRING, annotator STRING, vote STRING")
    for block in (8, 64):
        got = {(r["first"], r["second"], r["x"], r["y"]): r["n"] for r in human.annotator_pairs(df, block).collect()}
        assert got == want


def test_summary_scores(spark):
    df = spark.createDataFrame([
        (1, "d", "c", "The dogs were running. A cat sat.", "A cat sat. Dog run.", "running cats"), (2, "d", "c", "", "a", ""), (3, "d", "c", None, "b", "")], preds(spark).schema)
    got = {(r["doc_id"], r["metric"]): (r["a"], r["b"]) for r in evaluate.summary_scores(df).collect()}
    # dog, run, a, cat, sat are common; in one list at most three of them are in order, sentence by sentence all five
    assert got[1, "rouge1"][0] == pytest.approx(10 / 12) and got[1, "rougeL"][0] == pytest.approx(6 / 12) and got[1, "rougeLsum"][0] == pytest.approx(10 / 12)
    assert got[1, "rougeL"][1] == pytest.approx(4 / 9) and got[2, "rougeLsum"] == (0.0, 0.0) == got[3, "rouge1"]
    plain = {r["metric"]: r["b"] for r in evaluate.summary_scores(df, use_stems=False).filter("doc_id = 1").collect()}
    assert plain["rouge1"] == pytest.approx(2 / 9)


def test_checks(spark):
    df = spark.createDataFrame([(1, "a"), (2, "")], "k LONG, t STRING")
    v = checks.row_checks(df, {"empty": F.col("t") == "", "none": F.col("k") < 0})
    assert {r["check"]: r["n"] for r in v.collect()} == {"empty": 1, "none": 0}
    with pytest.raises(checks.DataError):
        checks.raise_on(v)
    other = spark.createDataFrame([(1, "b"), (3, "c")], "k LONG, t STRING")
    assert checks.keyed_equal(df, other, ["k"], ["t"], "same").first()["n"] == 3
    assert checks.same_size({"a": df, "b": other.limit(1)}).first()["n"] == 1
    assert checks.chosen(["1", "2M", "1M"], ["1M", "2M"], {"1": "1M"}) == ["1M", "2M"]
    with pytest.raises(checks.DataError):
        checks.chosen(["9M"], ["1M"])
    with pytest.raises(checks.DataError):
        checks.need_columns(df, ["summary"], "pairs")


RESULT = "doc_id LONG, winner STRING"


def _judge(rows):
    return judge.one_order(rows).select("doc_id", "winner")


def test_resume_adds_nothing_twice(spark, tmp_path):
    path = str(tmp_path / "run")
    work = preds(spark)
    continue_run(work.limit(2), path, ["doc_id"], RESULT, _judge)
    continue_run(work, path, ["doc_id"], RESULT, _judge)
    first = sorted(map(tuple, results_so_far(spark, path, RESULT).collect()))
    continue_run(work, path, ["doc_id"], RESULT, _judge)
    assert sorted(map(tuple, results_so_far(spark, path, RESULT).collect())) == first
    assert first == sorted(map(tuple, _judge(work).collect()))


def test_stream_judges_each_file_once(spark, tmp_path):
    source, out, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    schema = preds(spark).schema.simpleString()[7:-1]
    ddl = "doc_id LONG, dataset STRING, checkpoint STRING, reference STRING, summary_a STRING, summary_b STRING"
    assert schema
    preds(spark).filter("doc_id <= 3").write.parquet(source)
    judge_arrivals(spark, source, ddl, out, state, _judge).awaitTermination()
    preds(spark).filter("doc_id > 3").write.mode("append").parquet(source)
    judge_arrivals(spark, source, ddl, out, state, _judge).awaitTermination()
    got = sorted((r["doc_id"], r["winner"]) for r in spark.read.parquet(out).collect())
    assert got == sorted(map(tuple, _judge(preds(spark)).collect()))


def test_failing_judge_fails_the_run(spark):
    def make():
        def answer(prompts):
            raise RuntimeError("no answer")
        return answer

    prompts = spark.createDataFrame([(1, "p")], "k LONG, prompt STRING")
    with pytest.raises(Exception, match="no answer"):
        judge.run_judge(prompts, ["k"], make).collect()


def test_verdict_does_not_depend_on_length(spark):
    long = "alpha beta gamma " * 40
    df = spark.createDataFrame([("alpha beta gamma delta", long, "zeta")], "r STRING, a STRING, b STRING")
    got = df.select(judge.rule_completion(F.col("r"), F.col("a"), F.col("b")).alias("c")).first()["c"]
    assert len(long) > 500 and got.endswith("[RESULT] A")


def test_votes_keep_long_item_numbers(spark):
    from salience.sources import packets
    cells = spark.createDataFrame([("1234567890123456789", "x", "faithfulness", "a"), ("12345678901234567890", "x", "faithfulness", "a")],
                                  "item STRING, annotator STRING, dimension STRING, cell STRING")
    assert packets.votes_from(cells).first()["item"] == 1234567890123456789
    assert [r["item"] for r in packets.vote_violations(cells).collect()] == ["12345678901234567890"]


@pytest.mark.parametrize("n", [60, 1000])
def test_replicates_are_exact(n):
    w = evaluate.bootstrap_weights(7, n)
    assert len(w) == n + 1 and w[0] == 1 and 0.7 < w[1:].mean() < 1.4


def test_published_t_value():
    from salience.functions.tdist import t_two_sided
    assert float(t_two_sided([2.2078], [10_000])[0]) == pytest.approx(0.02728, abs=2e-5)


def test_no_step_no_trend(spark):
    rates = spark.createDataFrame([("d", 1, 0.5), ("d", 1, 0.6), ("d", 1, 0.7)], "dataset STRING, step LONG, rate DOUBLE")
    assert length.trend(rates).count() == 0


def test_resume_takes_only_a_missing_folder_as_empty(spark, tmp_path):
    from pyspark.errors import AnalysisException
    from salience.streaming.judging import results_so_far
    assert results_so_far(spark, str(tmp_path / "none"), "a LONG").count() == 0
    (tmp_path / "odd").mkdir()
    with pytest.raises(Exception):
        results_so_far(spark, f"bad://{tmp_path}/odd", "a LONG").count()


def test_line_union_query_against_tables(spark, small):
    """The registered query on all documents, against walks through whole tables of subsequence lengths."""
    import collections
    import re

    from salience.plans.derive import predictions
    from salience.plans.evaluation import line_union_scores

    def places(ref, cand):
        best = [[0] * (len(cand) + 1) for _ in range(len(ref) + 1)]
        for i, x in enumerate(ref):
            for j, y in enumerate(cand):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        out, i, j = set(), len(ref), len(cand)
        while i and j:
            if ref[i - 1] == cand[j - 1]:
                i, j = i - 1, j - 1
                out.add(i)
            elif best[i][j - 1] > best[i - 1][j]:
                j -= 1
            else:
                i -= 1
        return out

    toks = lambda t: re.findall("[a-z0-9]+", t.lower())
    want = {}
    for r in predictions(spark, small, with_text=True).collect():
        ref, cand = [toks(s) for s in r["sents"]], [toks(r["summary_a"]), toks(r["summary_b"])]
        found, left = collections.Counter(), collections.Counter(w for line in cand for w in line)
        for line in ref:
            found.update(line[i] for i in set().union(*[places(line, c) if set(line) & set(c) else set() for c in cand]))
        n = sum(map(len, ref)) + sum(map(len, cand))
        want[r["doc_id"]] = round(2 * sum(min(k, left[w]) for w, k in found.items()) / n, 6) if n else 0.0
    got = {r["doc_id"]: r["score"] for r in line_union_scores(spark, small).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[d] - want[d]) < 2e-6 for d in want)


def test_difference_of_stored_tables(spark):
    """Only buckets that differ are opened; nulls equal nulls, and the order of rows does not matter."""
    a = spark.createDataFrame([(i, f"t{i}" if i % 7 else None, i * 2) for i in range(500)] + [(None, "n", 1)], "k long, t string, v long")
    b = a.filter("k IS NULL OR k <> 3").withColumn("t", F.when(F.col("k").isin(5, 14), "x").otherwise(F.col("t"))).unionByName(
        spark.createDataFrame([(900, None, 1)], "k long, t string, v long")).repartition(5)
    want = {(3, "first"), (5, "changed"), (14, "changed"), (900, "second")}
    for buckets in (1, 16, 4096):
        assert {tuple(r) for r in checks.table_difference(a, b, ["k"], ["t", "v"], buckets).collect()} == want
        assert checks.table_difference(a, a.repartition(3), ["k"], ["t", "v"], buckets).count() == 0
    assert checks.table_difference(a, a.limit(0), ["k"], ["t"]).filter("side = 'first'").count() == 501
    with pytest.raises(checks.DataError):
        checks.raise_on(checks.keyed_equal(a, b, ["k"], ["t", "v"], "same"))


def test_stored_selections_of_tables_with_nulls(spark, tmp_path):
    from salience.plans.catalog import QUERIES

    text = "The cat sat. A dog ran by. The cat ran off with a dog!"
    docs = [(1, text), (2, None), (3, ""), (4, "...!?"), (5, "One sentence"), (None, text), (6, text)]
    tables = {"documents": ([(i, t, "en", "src0") for i, t in docs], "doc_id LONG, text STRING, lang STRING, source STRING"),
              "pages": ([(0, "http://a"), (1, None)], "page_id LONG, url STRING"), "benchmark": ([(0, "item"), (1, None), (2, "")], "item_id LONG, text STRING")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    # documents without a sentence or an id are in no selection, pages and tests are in theirs whatever their text
    for name in ("compared_selections", "compared_three_selections"):
        found = {r.doc_id: r.misaligned for r in run(name)}
        assert found == {1: False, 5: False, 6: False}
    sides = {r.doc_id: r.side for r in run("selection_difference")}
    foreign = {1_000_000_000: "first", 1_000_000_001: "first", **{2_000_000_000 + i: "second" for i in range(3)}}
    assert {k: v for k, v in sides.items() if v != "changed"} == foreign and set(sides) - set(foreign) <= {1, 6}
    assert {r.check: r.n for r in run("selection_checks")} == {"rows:b": 1, "same_pairs": len(sides), "same_again": 0}
