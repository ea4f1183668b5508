import uuid
from dataclasses import replace

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tests.conftest import mini_rows
from quarrylight import schemas
from quarrylight.operators import quality
from quarrylight.plans import source_queries
from quarrylight.sources import catalog as catalogs
from quarrylight.sources import runs as run_files
from quarrylight.sources.embeddings import embed_texts, extend_store
from quarrylight.sources.staging import staging_dir
from quarrylight.sources.validation import check_rows, quarantined_rows, valid_rows
from quarrylight.streaming import streams


def rules(df):
    return {r["rule"]: (r["violations"], r["sample"]) for r in df.collect()}


def test_clean_keys_and_references(mini):
    assert all(v == 0 for v, _ in rules(quality.primary_keys(mini)).values())
    assert all(v == 0 for v, _ in rules(quality.foreign_keys(mini)).values())


def test_planted_defects_are_found(spark, mini):
    rows = mini_rows()
    tables = [*rows["tables"], ("TBL-X", *rows["tables"][0][1:]), rows["tables"][0]]
    edges = [*rows["report_table_edges"], ("RPT-0001", "TBL-404")]
    dirty = replace(
        mini, tables=spark.createDataFrame(tables, schemas.TABLES),
        report_table_edges=spark.createDataFrame(edges, schemas.REPORT_TABLE_EDGES), built={}, prepared={},
    )
    keys = rules(quality.primary_keys(dirty))
    assert keys["tables.unique"] == (1, "TBL-001") and keys["tables.format"] == (1, "TBL-X")
    assert rules(quality.foreign_keys(dirty))["report_table_edges.table_id"] == (1, "TBL-404")


def test_tree_and_heads(mini):
    tree = rules(quality.manager_tree(mini))
    assert tree["single_root"] == (1, "EMP-013")  # a second person without a manager
    assert tree["connected"] == (1, "EMP-013")
    assert rules(quality.one_head(mini))["head_active"][0] == 0


def test_csv_round_trip(spark, mini):
    path = f"{staging_dir(spark)}/round-trip-{uuid.uuid4().hex}"
    catalogs.write_catalog(mini, path)
    back = catalogs.read_catalog(spark, path)
    for name in schemas.CATALOG:
        assert sorted(map(str, getattr(back, name).collect())) == sorted(map(str, getattr(mini, name).collect()))
    raw = catalogs.read_raw_strings(spark, path, "employees").where("employee_id = 'EMP-001'").first()
    assert raw["manager_id"] == "" and raw["is_department_head"] == "true"
    with pytest.raises(FileNotFoundError):
        catalogs.read_catalog(spark, path + "-missing")


def test_tables_are_exported_when_they_are_read(spark, mini, monkeypatch):
    monkeypatch.setattr(source_queries, "catalog", lambda spark, sf: mine)
    mine = replace(mini, built={}, prepared={})
    path = source_queries.exported(spark, "", ["reports"])
    wanted = sorted(map(str, catalogs.export_strings(mini.reports, "reports").collect()))
    assert sorted(map(str, catalogs.read_raw_strings(spark, path, "reports").collect())) == wanted
    with pytest.raises(AnalysisException):
        catalogs.read_raw_strings(spark, path, "tables").collect()
    assert source_queries.exported(spark, "") == path
    assert catalogs.read_raw_strings(spark, path, "tables").count() == mini.tables.count()


def test_rows_are_validated(spark, mini):
    raw = catalogs.export_strings(mini.employees, "employees").withColumn(
        "start_date", F.when(F.col("employee_id") == "EMP-004", "soon").otherwise(F.col("start_date"))
    ).withColumn("full_name", F.when(F.col("employee_id") == "EMP-005", "").otherwise(F.col("full_name")))
    checked = check_rows(raw, "employees", ["Operations", "Sales", "Data & Analytics"])
    bad = {r["employee_id"]: r["reasons"] for r in quarantined_rows(checked).collect()}
    assert bad == {"EMP-004": ["start_date: not a date"], "EMP-005": ["full_name: empty"]}
    good = valid_rows(checked, "employees")
    assert good.count() == 12
    assert [f.dataType for f in good.schema] == [f.dataType for f in schemas.EMPLOYEES]


def test_answers_are_appended_once(spark):
    path = f"{staging_dir(spark)}/answers-test-{uuid.uuid4().hex}"
    rows = [("A0", 1, "i1", 5, "m"), ("A0", 1, "i1", 3, "m"), ("A0", 1, "i2", 4, "m")]
    schema = "config string, repeat int, item_id string, event_id long, model string"
    first = spark.createDataFrame(rows, schema)
    run_files.append_answers_once(spark, path, first, ["model"], "event_id")
    more = spark.createDataFrame([("A0", 1, "i2", 9, "m"), ("A1", 1, "i1", 8, "m")], schema)
    stored = run_files.append_answers_once(spark, path, more, ["model"], "event_id")
    assert {(r["config"], r["item_id"], r["event_id"]) for r in stored.collect()} == {
        ("A0", "i1", 3), ("A0", "i2", 4), ("A1", "i1", 8)
    }
    foreign = spark.createDataFrame([("A2", 1, "i1", 1, "other")], schema)
    with pytest.raises(ValueError):
        run_files.append_answers_once(spark, path, foreign, ["model"], "event_id")


def test_store_encodes_only_new_texts(spark):
    path = f"{staging_dir(spark)}/vectors-test-{uuid.uuid4().hex}"
    one = spark.createDataFrame([("a b",), ("c",), ("a b",)], "t string")
    two = spark.createDataFrame([("c",), ("d e",)], "t string")
    assert extend_store(path, one, "t", "m", dim=8).count() == 2
    assert extend_store(path, two, "t", "m", dim=8).count() == 3
    with pytest.raises(Exception, match="encoder returned"):
        embed_texts(one.withColumn("k", F.lit("x")), "k", "t", lambda dim: lambda found: np.ones((len(found), dim + 1)), 8).collect()


def test_failure_stops_batch_matches_a_scan(spark):
    import random

    rng = random.Random(2)
    rows = [(f"r{i % 3}", i * 20_000, rng.random() < 0.6) for i in range(400)]
    df = spark.createDataFrame(rows, "run string, s long, failed boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["run"], r["ts"].timestamp()) for r in streams.failure_stops_batch(df).collect()}
    expected = set()
    for run in ("r0", "r1", "r2"):
        streak = 0
        for r, s, failed in rows:
            if r == run:
                streak = streak + 1 if failed else 0
                if streak == 3:
                    expected.add((run, s))
    offset = spark.range(1).select(F.timestamp_seconds(F.lit(0)).alias("t")).first()["t"].timestamp()
    assert {(r, t - offset) for r, t in got} == expected


def test_texts_without_a_word_have_no_opening_word(spark, mini):
    texts = spark.createDataFrame([("Order one",), ("order two",), ("-- x1",), ("",), ("… 中",), (None,)], "t string")
    got = {r["word"]: (r["n"], round(r["share"], 6)) for r in quality.opening_words(texts, "t").collect()}
    assert got == {"order": (2, 0.666667), "x1": (1, 0.333333)}
    assert quality.opening_words(texts.where("t = ''"), "t").collect() == []
