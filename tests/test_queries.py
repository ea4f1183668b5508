"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from quarrylight.plans.registry import ORACLES, QUERIES
from tools.check import TABLES, normal

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "impact_fanout", "impact_contacts", "resolve_owner", "trace_lineage", "bm25_score", "search",
    "search_assets", "dense_search", "accuracy_grid", "ablation_table", "bootstrap_ci",
    "classify_error", "similar_name_pairs", "dq_foreign_keys", "dq_tree", "dq_temporal",
    "gold_impact_notify", "baseline_accuracy", "bench_summary", "allocate_targets",
    "replay_rewrite", "read_catalog", "append_answers_once", "stream_failure_streak",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    __spark_entry__.queries()
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, db, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    result = db.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    mine = sorted(tuple(normal(r[c]) for c in order) for r in df.collect())
    theirs = sorted(tuple(normal(r[columns.index(c)]) for c in order) for r in result.fetchall())
    assert mine == theirs
