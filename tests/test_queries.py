"""Every registered query against its SQL on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tools.check import TABLES, norm

# slow or file-writing ones are left to tools/check.py
SAMPLE = ["rouge1_pairs", "rouge2_scores", "count_pmi_scores", "hashed_context_similarity", "selector_agreement", "metric_scores",
          "corrected_per_dataset", "consensus_stats", "length_bins", "human_judge_agreement", "intrinsic_negatives", "extrinsic_negatives",
          "vector_salience", "greedy_match", "resumed_run"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert cols == sorted(names)
    want = sorted("|".join(norm(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert sorted("|".join(norm(r[c]) for c in cols) for r in df.collect()) == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
