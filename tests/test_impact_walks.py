"""Impact found by walks up a handed graph, against the joins that graphs over its bounds are walked with."""

import random
from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import handed_graph, impact, impact_walks
from tests.conftest import table_id


def odd(spark, mini):
    """The mini catalog with a cycle, a table nobody lists, repeated rows, an owner who does not exist, missing values."""
    edges = [(8, 9), (9, 8), (9, 20), (20, 21), (21, 20), (5, 20), (7, 7), (1, 6)]
    tables = mini.tables.union(mini.tables.limit(1)).union(
        mini.tables.where("table_id = 'TBL-008'").withColumn("table_id", F.lit("TBL-009"))
    )
    more = spark.createDataFrame([(table_id(a), table_id(b), "join") for a, b in edges] + [(None, "TBL-003", "join")],
                                 mini.table_table_edges.schema)
    links = spark.createDataFrame([("RPT-0003", "TBL-020"), ("RPT-0004", "TBL-021"), ("RPT-0009", "TBL-020"), ("RPT-0009", "TBL-021"),
                                   ("RPT-0010", "TBL-009"), ("RPT-0010", None), ("RPT-0011", "TBL-404")], mini.report_table_edges.schema)
    reports = mini.reports.union(mini.reports.where("report_id IN ('RPT-0001', 'RPT-0002')").withColumn("usage_30d", F.lit(7).cast("bigint")))
    for name, owner, usage in (("RPT-0009", "EMP-014", None), ("RPT-0010", "EMP-999", 3), ("RPT-0011", None, 5)):
        reports = reports.union(mini.reports.where("report_id = 'RPT-0005'").withColumns(
            {"report_id": F.lit(name), "owner_id": F.lit(owner).cast("string"), "usage_30d": F.lit(usage).cast("bigint")}))
    return replace(
        mini, built={}, prepared={}, tables=tables, reports=reports,
        table_table_edges=mini.table_table_edges.union(more), report_table_edges=mini.report_table_edges.union(links),
        employees=mini.employees.union(mini.employees.where("employee_id = 'EMP-004'").withColumn("department", F.lit("Data & Analytics"))),
    )


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_walks_give_the_rows_of_the_joins(spark, mini, monkeypatch):
    monkeypatch.setattr(impact, "NOTIFY_DETAIL_MAX", 2)
    monkeypatch.setattr(impact, "NOTIFY_BROADCAST_TOP", 1)
    monkeypatch.setattr(impact, "PERSON_UNITS", 2)
    monkeypatch.setattr(impact, "PART_UNITS", 2)
    asked = spark.createDataFrame([(n, table_id(n)) for n in (1, 4, 8, 9, 20)], "request_id int, table_id string")
    found = {}
    for bound in (handed_graph.HANDED_EDGES, 0):
        monkeypatch.setattr(handed_graph, "HANDED_EDGES", bound)
        cat = odd(spark, mini)
        assert (impact.table_graph(cat) is None) is (bound == 0)
        found[bound] = {
            name: rows(operator(cat)) for name, operator in {
                "affected": impact.affected, "closure": impact.impact_closure, "contacts": impact.impact_contacts,
                "summary": impact.impact_summary, "ranked": impact.notify_ranked, "rollup": impact.impact_rollup,
                "shown": lambda c: impact.impact_shown(c, 700).drop("position"), "fanout": lambda c: impact.impact_fanout(c, 700),
                "answers": lambda c: impact.impact_answers(c, asked, 700),
            }.items()
        }
        assert ("affected" in cat.built and "table_closure" in cat.built) is (bound == 0)
    walked, joined = found.values()
    assert len(joined["affected"]) > 30 and len(joined["rollup"]) > 3
    for name in joined:
        assert walked[name] == joined[name], name


def brute(edges, listed, seeds, unit, own):
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    out = set()
    for start in unit:
        seen, todo = set(), [start]
        while todo:
            for b in up.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out |= seen - {start} | ({start} if own and start in listed else set())
    return out & seeds


def unit_batch(units, told):
    n = len(units)
    return pa.RecordBatch.from_pydict({
        "asset_id": [f"A{k:03d}" for k in range(n)], "type": ["report" if own else "table" for _, own in units],
        "told": [t is not None for t in told], "usage_30d": pa.array([k % 5 if k % 7 else None for k in range(n)], pa.int64()),
        "notify_id": pa.array(told, pa.string()), "owner_resolved": [k % 3 > 0 for k in range(n)], "broken": [False] * n,
        "item_chars": [20 + k % 4 for k in range(n)], "starts": [[f"T{t:02d}" for t in starts] for starts, _ in units],
        "position": list(range(n)), "departments": pa.array(told, pa.string()),
    })


@pytest.mark.parametrize("pairs,gathered", [(handed_graph.PAIRS, impact_walks.GATHERED), (40, 30)])
def test_portions_and_flushes_lose_nothing(monkeypatch, pairs, gathered):
    """Walks over portions of a few pairs, rows put together and given back many times: the sums are those of plain sets."""
    monkeypatch.setattr(handed_graph, "PAIRS", pairs)
    monkeypatch.setattr(impact_walks, "GATHERED", gathered)
    rnd = random.Random(5)
    edges = {(rnd.randrange(30), rnd.randrange(30)) for _ in range(40)}
    listed = set(range(0, 30, 2))
    names = pa.array([f"T{n:02d}" for n in range(30)])
    there = np.isin(np.arange(30), list(listed))
    tail, head = (np.array(c, np.int64) for c in zip(*sorted(edges), strict=True))
    led = np.zeros(30, bool)
    led[head] = True
    graph = handed_graph.Graph(names, *handed_graph.arcs(tail, head, 30), there, there | led)
    units = [([k % 30], False) for k in range(30)] + [(rnd.sample(range(30), rnd.randrange(1, 5)), True) for _ in range(120)]
    told = [None] * 30 + sorted(f"P{rnd.randrange(25):02d}" for _ in range(120))
    expected = [brute(edges, listed, set(np.flatnonzero(graph.seeds)), starts, own) for starts, own in units]
    batch = unit_batch(units, told)
    found = [set() for _ in units]
    for unit, node in impact_walks.portions(graph, batch):
        for u, n in zip(unit.tolist(), node.tolist(), strict=True):
            assert n not in found[u]
            found[u].add(n)
    assert found == expected
    run = impact_walks.digest(SimpleNamespace(value=graph), [3, 50, 50, 2], 4, False)
    halves = [batch.slice(0, 70), batch.slice(70)]
    out = pa.Table.from_batches(list(run(iter(halves)))).to_pylist()
    counts, people, contacts = {}, {}, {}
    for k, nodes in enumerate(expected):
        for n in nodes:
            counts[n, 1 if units[k][1] else 2] = counts.get((n, 1 if units[k][1] else 2), 0) + 1
            if told[k]:
                people.setdefault((n, told[k]), []).append(k)
    for r in out:
        n = int(r["table_id"][1:])
        if r["kind"] == impact_walks.SUMS and r["cut_order"] < 3:
            counts[n, r["cut_order"]] -= r["n"]
        if r["kind"] == impact_walks.DEPARTMENTS:
            contacts[n, r["label"]] = contacts.get((n, r["label"]), 0) + r["m"]
    assert not any(counts.values()) and contacts == {k: len(v) for k, v in people.items()}
    for n in range(30):
        items = sorted((-1 if r["place"] is None else 1, r["place"] or 0, r["position"]) for r in out
                       if r["kind"] == impact_walks.ITEMS and r["cut_order"] == 1 and r["table_id"] == f"T{n:02d}")
        mine = sorted((-1, 0, k) if k % 7 == 0 else (1, -(k % 5), k) for k in range(30, 150) if n in expected[k])
        assert items[:3] == mine[:3]
        usage = {p: [k % 5 for k in ks if k % 7] for (m, p), ks in people.items() if m == n}
        first = sorted(usage, key=lambda p: (-sum(usage[p]) if usage[p] else 99, p))[:4]
        given = {r["label"]: r for r in out if r["kind"] == impact_walks.PEOPLE and r["table_id"] == f"T{n:02d}"}
        assert set(first) <= set(given)
        assert all(given[p]["usage"] == (sum(usage[p]) if usage[p] else None) and given[p]["n"] == len(people[n, p]) for p in first)
