"""One local session for all tests, and the hand-made mini catalog."""

from __future__ import annotations

import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quarrylight import schemas  # noqa: E402
from quarrylight.session import local_session  # noqa: E402
from quarrylight.sources.catalog import Catalog  # noqa: E402

HEADS = {"EMP-001": "Operations", "EMP-002": "Sales", "EMP-003": "Data & Analytics"}
# owner -> (manager, successor); everybody listed here has left.
GONE = {
    "EMP-005": ("EMP-002", "EMP-006"), "EMP-006": ("EMP-002", "EMP-007"),
    "EMP-007": ("EMP-002", "EMP-008"), "EMP-008": ("EMP-002", "EMP-004"),
    "EMP-009": ("EMP-003", "EMP-010"), "EMP-010": ("EMP-003", None),
    "EMP-011": ("EMP-002", "EMP-012"), "EMP-012": ("EMP-002", "EMP-011"),
    "EMP-013": (None, None),
}
REPORTS = {
    "RPT-0001": ("EMP-004", 120), "RPT-0002": ("EMP-008", 40), "RPT-0003": ("EMP-010", 15),
    "RPT-0004": ("EMP-014", 1), "RPT-0005": ("EMP-009", 60), "RPT-0006": ("EMP-006", 30),
    "RPT-0007": ("EMP-005", 5), "RPT-0008": ("EMP-011", 0),
}
TABLE_EDGES = [(1, 3), (1, 7), (2, 4), (3, 4), (3, 5), (4, 5), (4, 6)]
REPORT_EDGES = [(1, 5), (1, 6), (2, 5), (3, 7), (4, 6), (5, 6), (6, 5), (7, 4), (8, 7)]
METRICS = {"MET-001": ("EMP-004", [5]), "MET-002": ("EMP-005", [5, 6]), "MET-003": ("EMP-007", [7])}


def table_id(n: int) -> str:
    return f"TBL-{n:03d}"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "quarrylight-tests")
    yield session
    session.stop()


def mini_rows() -> dict[str, list[tuple]]:
    employees = []
    for n in range(1, 15):
        person = f"EMP-{n:03d}"
        manager, successor = GONE.get(person, ("EMP-002", None))
        if person in HEADS:
            manager = None if person == "EMP-001" else "EMP-001"
        gone = person in GONE
        employees.append(
            (person, f"Person {n}", HEADS.get(person, "Sales"), "Analyst", person in HEADS,
             "left" if gone else "active", manager, successor, date(2020, 1, 1),
             date(2024, 1, 1) if gone else None)
        )
    reports = [
        (rid, f"Report {rid[-1]}", "Main", owner, "Sales", "About sales.", date(2023, 1, 1),
         date(2025, 1, 1), "disabled" if rid == "RPT-0004" else "success", "sales|gm", usage,
         "deprecated" if rid == "RPT-0004" else "active",
         "RPT-0005" if rid == "RPT-0004" else None)
        for rid, (owner, usage) in REPORTS.items()
    ]
    layer = {1: "staging", 2: "staging", 3: "intermediate", 4: "intermediate", 8: "staging"}
    prefix = {"staging": "stg", "intermediate": "int", "mart": "fct"}
    tables = []
    for n in range(1, 9):
        kind = layer.get(n, "mart")
        tables.append(
            (table_id(n), f"{prefix[kind]}_table_{n}", kind, "ERP", "core", "EMP-004", "A table.",
             '[{"name":"order_id","type":"string"}]', 10, "daily")
        )
    metrics = [
        (mid, f"Metric {mid[-1]}", f"M{mid[-1]}A|gross margin", "A ratio.",
         None if mid == "MET-003" else "a/b", str([table_id(t) for t in sources]).replace("'", '"'), owner)
        for mid, (owner, sources) in METRICS.items()
    ]
    requests = [
        (f"REQ-{n:04d}", f"Title {n}", f"Please look at case {n}.", "EMP-004", "EMP-003", "Sales",
         date(2022, 1, n), date(2022, 2, n), "done", "RPT-0001", None)
        for n in range(1, 7)
    ]
    return {
        "employees": employees,
        "reports": reports,
        "tables": tables,
        "report_table_edges": [(f"RPT-{r:04d}", table_id(t)) for r, t in REPORT_EDGES],
        "table_table_edges": [(table_id(a), table_id(b), "join") for a, b in TABLE_EDGES],
        "metrics": metrics,
        "requests": requests,
    }


@pytest.fixture(scope="session")
def mini(spark) -> Catalog:
    rows = mini_rows()
    return Catalog(
        **{name: spark.createDataFrame(rows[name], schemas.CATALOG[name]) for name in schemas.CATALOG}
    )
