import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.conftest import table_id
from quarrylight.operators import gold, impact, ownership
from quarrylight.operators.limits import fit_to_limit
from quarrylight.operators.scoring import score_columns

WALKS = {
    "EMP-004": ("active_owner", 0, "EMP-004"), "EMP-008": ("resolved_via_chain", 1, "EMP-004"),
    "EMP-010": ("resolved_via_chain", 1, "EMP-003"), "EMP-007": ("resolved_via_chain", 2, "EMP-004"),
    "EMP-009": ("resolved_via_chain", 2, "EMP-003"), "EMP-006": ("resolved_via_chain", 3, "EMP-004"),
    "EMP-005": ("depth_limit", 3, "EMP-002"), "EMP-011": ("cycle", 1, "EMP-002"),
    "EMP-012": ("cycle", 1, "EMP-002"), "EMP-013": ("dead_end", 0, "EMP-002"),
}


def test_walks(mini):
    got = {r["employee_id"]: r for r in ownership.build_walks(mini).collect()}
    for person, (reason, hops, contact) in WALKS.items():
        row = got[person]
        assert (row["reason"], row["hops"], row["contact_id"]) == (reason, hops, contact), person
    vias = [p["via"] for p in got["EMP-009"]["path"]]
    assert vias == ["owner", "successor", "manager"]


def test_dangling_pointer_is_an_internal_error(spark, mini):
    broken = mini.employees.withColumn(
        "successor_id",
        F.expr("CASE WHEN employee_id = 'EMP-008' THEN 'EMP-999' ELSE successor_id END"),
    )
    reports = mini.reports.withColumn("owner_id", F.expr("IF(report_id = 'RPT-0003', 'EMP-998', owner_id)"))
    catalog = replace(mini, employees=broken, reports=reports, built={}, prepared={})
    asked = spark.createDataFrame(
        [("RPT-0002",), ("RPT-9999",), ("EMP-001",), ("RPT-0001",), ("RPT-0003",)], "asset_id string"
    )
    got = {r["asset_id"]: r["error"] for r in ownership.resolve_owner(catalog, asked).collect()}
    assert got == {"RPT-0002": "INTERNAL", "RPT-9999": "NOT_FOUND", "EMP-001": "INVALID_ARGUMENT",
                   "RPT-0001": None, "RPT-0003": "INTERNAL"}


def test_impact_of_table_four(mini):
    answer = {r["table_id"]: r for r in impact.impact_analysis(mini).collect()}[table_id(4)]
    assert answer["affected_tables"] == [table_id(5), table_id(6)]
    assert answer["affected_metrics"] == ["MET-001", "MET-002"]
    assert answer["affected_reports"] == [f"RPT-{n:04d}" for n in (1, 5, 2, 6, 7, 4)]
    assert answer["unresolved_asset_ids"] == ["MET-002", "RPT-0007"]
    assert (answer["notify_mode"], answer["notify_total_count"]) == ("individual", 3)
    assert (answer["affected_report_count"], answer["affected_metric_count"]) == (6, 2)
    assert not answer["truncated"]
    people = [r for r in impact.notify_list(mini).orderBy("rank").collect() if r["table_id"] == table_id(4)]
    assert [(p["employee_id"], p["total_usage_30d"], p["via_fallback"]) for p in people] == [
        ("EMP-004", 190, False), ("EMP-003", 60, False), ("EMP-002", 5, True)
    ]


def test_isolated_table_affects_nothing(mini):
    answer = {r["table_id"]: r for r in impact.impact_analysis(mini).collect()}[table_id(8)]
    assert answer["affected_reports"] == [] and answer["notify_total_count"] == 0


def test_broadcast_mode(mini, monkeypatch):
    monkeypatch.setattr(impact, "NOTIFY_DETAIL_MAX", 2)
    monkeypatch.setattr(impact, "NOTIFY_BROADCAST_TOP", 1)
    modes = {r["table_id"]: r["notify_mode"] for r in impact.notify_modes(mini).collect()}
    assert modes[table_id(4)] == "broadcast" and modes[table_id(8)] == "individual"
    rows = [r for r in impact.impact_rollup(mini).orderBy("rank").collect() if r["table_id"] == table_id(4)]
    assert [(r["department"], r["people_count"], r["report_count"]) for r in rows] == [
        ("Sales", 2, 4), ("Data & Analytics", 1, 1)
    ]
    monkeypatch.setattr(impact, "notify_ranked", lambda c, limit=2, f=impact.notify_ranked: f(c, limit))
    shown = [r for r in impact.notify_list(mini).collect() if r["table_id"] == table_id(4)]
    assert [(r["employee_id"], r["notify_omitted_count"]) for r in shown] == [("EMP-004", 2)]


def test_gold_of_contacts(spark, mini):
    specs = spark.createDataFrame(
        [("one", "RPT-0002"), ("two", "RPT-0001"), ("two", "RPT-0007")], "item_id string, asset_id string"
    )
    got = {tuple(r) for r in gold.current_contacts(mini, specs).collect()}
    assert got == {("one", "EMP-004", False), ("one", "EMP-008", True), ("two", "EMP-004", False),
                   ("two", "EMP-002", False), ("two", "EMP-005", True)}


def trim(lists, base, limit):
    """The reference rule, one item at a time."""
    kept = {k: list(v) for k, v in lists.items()}

    def size(cut):
        return base - (1 if cut else 0) + sum(sum(v) + max(len(v) - 1, 0) for v in kept.values())

    cut = False
    if size(False) <= limit:
        return kept, False
    for order in sorted(kept):
        while kept[order] and size(cut) > limit:
            kept[order].pop()
            cut = True
        if size(cut) <= limit:
            break
    return kept, True


def test_fit_to_limit_matches_trimming(spark):
    rng = random.Random(11)
    fixed, items, cases = [], [], {}
    for n in range(60):
        lists = {o: [rng.randrange(2, 30) for _ in range(rng.randrange(0, 12))] for o in (1, 2, 3)}
        base = rng.randrange(20, 120)
        chars = sum(sum(v) + max(len(v) - 1, 0) for v in lists.values())
        if n % 3 == 0 and 0 < chars < 200:
            base = 201 - chars
        cases[n] = (lists, base)
        fixed.append((n, base))
        items += [(n, o, p, c) for o, v in lists.items() for p, c in enumerate(v)]
    kept = fit_to_limit(
        spark.createDataFrame(fixed, "k int, base_chars int"),
        spark.createDataFrame(items, "k int, cut_order int, place int, item_chars int"),
        ["k"], ["place"], 200,
    ).collect()
    for n, (lists, base) in cases.items():
        expected, cut = trim(lists, base, 200)
        rows = [r for r in kept if r["k"] == n]
        for order in (1, 2, 3):
            assert sum(1 for r in rows if r["cut_order"] == order) == len(expected[order]), n
        assert all(r["truncated"] is cut for r in rows)


@pytest.mark.parametrize("rule,given,gold_ids,abstained,expected", [
    ("contains_all", ["a", "b"], ["a"], False, True), ("contains_all", ["b"], ["a"], False, False),
    ("contains_any", ["b", "c"], ["a", "b"], False, True), ("set_f1", ["a", "b", "c"], ["a", "b"], False, True),
    ("set_f1", ["a", "c"], ["a", "b"], False, False), ("abstain", [], [], True, True),
    ("abstain", ["EMP-001"], [], True, False), ("contains_all", ["a"], ["a"], True, False),
])
def test_both_scorers_agree(spark, rule, given, gold_ids, abstained, expected):
    row = spark.createDataFrame([(rule, given, gold_ids, [], abstained)],
                                "r string, g array<string>, w array<string>, f array<string>, a boolean")
    cols = score_columns(*[F.col(c) for c in ("r", "g", "w", "f", "a")])
    assert row.select(cols["correct"].alias("c")).first()["c"] is expected
    long_gold = spark.createDataFrame([("i", x, False) for x in gold_ids], "item_id string, record_id string, forbidden boolean")
    long_given = spark.createDataFrame([("i", x) for x in given], "item_id string, record_id string")
    rules = spark.createDataFrame([("i", rule, abstained)], "item_id string, scoring string, abstained boolean")
    assert gold.score_sets(long_gold, long_given, rules).first()["correct"] is expected


def impact_of(spark, catalog, ids, limit=6000):
    asked = spark.createDataFrame(list(enumerate(ids)), "request_id int, table_id string")
    return {r["request_id"]: r for r in impact.impact_answers(catalog, asked, limit).collect()}


def test_impact_answers(spark, mini):
    got = impact_of(spark, mini, [table_id(4), f" {table_id(8)} ", "TBL-999", "RPT-0001", None, table_id(4)])
    answer = json.loads(got[0]["payload"])
    assert got[5]["payload"] == got[0]["payload"] and got[0]["payload_chars"] == len(got[0]["payload"])
    assert [r["report_id"] for r in answer["affected_reports"]] == [f"RPT-{n:04d}" for n in (1, 5, 2, 6, 7, 4)]
    assert answer["affected_reports"][-1] == {
        "report_id": "RPT-0004", "name": "Report 4", "status": "deprecated", "usage_30d": 1,
        "notify_employee_id": None, "owner_resolved": True,
    }
    assert answer["affected_tables"] == [table_id(5), table_id(6)]
    assert [(p["employee_id"], p["report_ids"], p["metric_ids"], p["via_fallback"]) for p in answer["notify"]] == [
        ("EMP-004", ["RPT-0001", "RPT-0002", "RPT-0006"], ["MET-001"], False), ("EMP-003", ["RPT-0005"], [], False),
        ("EMP-002", ["RPT-0007"], ["MET-002"], True),
    ]
    assert answer["unresolved_asset_ids"] == ["MET-002", "RPT-0007"] and answer["notify_rollup"] == []
    alone = json.loads(got[1]["payload"])
    assert alone["notify_total_count"] == 0 and alone["affected_reports"] == [] and not alone["truncated"]
    assert [got[i]["error"]["code"] for i in (2, 3, 4)] == ["NOT_FOUND", "INVALID_ARGUMENT", "INVALID_ARGUMENT"]


def test_impact_answers_are_cut_to_the_cap(spark, mini):
    whole = impact_of(spark, mini, [table_id(4)])[0]
    cut = impact_of(spark, mini, [table_id(4)], whole["payload_chars"] - 1)[0]
    shorter = json.loads(cut["payload"])
    assert cut["truncated"] and shorter["truncated"] and len(cut["payload"]) < whole["payload_chars"]
    assert [r["report_id"] for r in shorter["affected_reports"]] == [f"RPT-{n:04d}" for n in (1, 5, 2, 6, 7)]


def test_dangling_owner_makes_the_answer_internal(spark, mini):
    broken = replace(
        mini, built={}, prepared={},
        reports=mini.reports.withColumn("owner_id", F.expr("IF(report_id = 'RPT-0003', 'EMP-999', owner_id)")),
    )
    got = impact_of(spark, broken, [table_id(7), table_id(4), table_id(1)])
    assert [got[i]["error"] and got[i]["error"]["code"] for i in range(3)] == ["INTERNAL", None, "INTERNAL"]
    counts = {r["table_id"]: r["affected_report_count"] for r in impact.impact_summary(broken).collect()}
    assert counts[table_id(7)] == 2


def test_an_answer_too_long_for_one_value(spark, mini, monkeypatch):
    monkeypatch.setattr(impact, "PAYLOAD_CHARS", 400)
    got = impact_of(spark, mini, [table_id(4), table_id(8)])
    assert got[0]["error"]["code"] == "TOO_LARGE" and got[0]["payload"] is None and got[0]["payload_chars"] > 400
    assert got[1]["error"] is None


def test_affected_pairs_are_shuffled_without_what_the_asset_alone_decides(mini, monkeypatch, capsys):
    """Pairs are dealt out by asset once, as two IDs; the other columns join there."""
    from dataclasses import replace

    from quarrylight.operators import impact
    from quarrylight.sources.catalog import Catalog

    monkeypatch.setattr(Catalog, "once", lambda self, name, build: build())
    links = mini.report_table_edges
    twice = replace(mini, report_table_edges=links.union(links), built={}, prepared={})
    found = impact.affected(twice)
    found.explain()
    shuffles = [line for line in capsys.readouterr().out.splitlines() if "Exchange hashpartitioning(" in line]
    assert shuffles and not [line for line in shuffles if "usage_30d" in line and ("seed" in line or "table_id" in line)]
    rows = [tuple(r) for r in found.select("table_id", "asset_id").collect()]
    assert len(rows) == len(set(rows)) and ("TBL-004", "RPT-0007") in rows and ("TBL-008", "RPT-0001") not in rows
