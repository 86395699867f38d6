"""The pipeline's stages, each against brute force on its own input."""

import collections

import pytest

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_documents import check_pieces, line_brute, linked, mix_brute
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SMALL).write.parquet(f"{root}/{name}")
        out.append(spark.read.parquet(f"{root}/{name}"))
    return out


def texts(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_columns(outputs):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(df.columns == outputs[0].columns for df in outputs[:-1])


def test_quality_keeps_good_ones(spark, outputs):
    kept = {d for d, _ in texts(outputs[1])}
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").collect()
    assert all(r["doc_id"] in kept for r in labels if r["quality"] == 1)
    bad = [r["doc_id"] in kept for r in labels if r["quality"] == 0]
    assert sum(bad) <= 0.1 * len(bad)


def test_lines_and_copies(outputs):
    rows = [(d, t, None) for d, t in texts(outputs[1])]
    hashes = {r["doc_id"]: r["h"] for r in outputs[1].select("doc_id", F.xxhash64("text").alias("h")).collect()}
    gone = line_brute(rows, [hashes[d] for d, _, _ in rows], short=True)
    want = []
    for d, t, _ in rows:
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get((d, hashes[d]), []))
        if left.split() or (d, hashes[d]) not in gone:
            want.append((d, left))
    assert texts(outputs[2]) == sorted(want)
    stays = {d for d, _, c in linked([(d, t, None) for d, t in texts(outputs[2])], 5, 80, 100) if d == c}
    assert texts(outputs[3]) == [(d, t) for d, t in texts(outputs[2]) if d in stays]


def test_mix_and_packing(outputs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in outputs[3].collect()]
    _, target = mix_brute(rows)
    taken = collections.Counter()
    for r in outputs[4].collect():
        taken[r["source"]] += len(r["text"].split())
    for s, n in target.items():
        assert abs(taken[s] - n) <= 2 * max(len(t.split()) for _, t, x in rows if x == s) + 1
    total, ids = check_pieces(outputs[5].collect(), {d: t for d, t, _ in rows})
    times = collections.Counter(r["doc_id"] for r in outputs[4].collect())
    assert total == {d: len(ids[d]) * n for d, n in times.items()}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(60))
OTHER = " ".join(f"v{i}" for i in range(60))
ROWS = [(1, LONG, "en", "a", 1), (2, LONG, "en", "a", 1), (2, OTHER, "en", "a", 1), (3, OTHER + " more", "en", None, 1), (3, OTHER + " more", "en", None, 1),
        (None, LONG + " end", None, "b", None), (None, "unlike any other row", None, "b", None), (None, "unlike any other row", None, "b", None),
        (4, None, "en", "a", None), (5, "", "en", "a", 0), (6, " \n\t", "en", "a", 3), (7, "one", "en", "a", 3), (8, "one\none\ntwo words\n" + LONG, "en", "a", 9)]


def test_copies_row_by_row(spark, tmp_path):
    """One row of each group stays, whatever the ids; rows without words stay."""
    spark.createDataFrame(ROWS, SCHEMA).withColumn("_extra", F.lit(1)).write.parquet(f"{tmp_path}/rows")
    docs = spark.read.parquet(f"{tmp_path}/rows")
    kept = corpus_pipeline.drop_copies(spark, docs, SMALL)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    want = [(1, LONG), (2, OTHER), (None, "unlike any other row"), (4, None), (5, ""), (6, " \n\t"), (7, "one")]
    assert got == sorted(want, key=repr)


def test_stages_on_odd_rows(spark, tmp_path):
    """Every stage takes nulls, empty texts, repeated rows and empty tables."""
    for name, rows in (("odd", ROWS), ("none", [])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        for stage_name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            got = out.collect()
            assert bool(got) == bool(rows), stage_name
            assert stage_name == "packing" or out.columns == docs.columns
    left = corpus_pipeline.drop_lines(spark, spark.read.parquet(f"{tmp_path}/odd"), SMALL)
    texts_left = {r["doc_id"]: r["text"] for r in left.filter("doc_id > 3").collect()}
    assert texts_left == {4: None, 5: "", 6: " \n\t", 7: "one", 8: "two words"}
