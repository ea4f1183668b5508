"""Row checks on raw string tables: valid rows in one table, the rest with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight import schemas

DEPARTMENT_COLUMNS = {"department"}
# Which columns hold IDs of which kind, and which may be blank.
ID_COLUMNS = {
    "employee_id": "employee", "manager_id": "employee", "successor_id": "employee",
    "owner_id": "employee", "requester_id": "employee", "assignee_id": "employee",
    "report_id": "report", "replaced_by_report_id": "report", "resulting_report_id": "report",
    "table_id": "table", "parent_table_id": "table", "child_table_id": "table",
    "metric_id": "metric", "request_id": "request", "duplicate_of_request_id": "request",
}
OPTIONAL = {
    "employees": {"manager_id", "successor_id", "left_date"},
    "reports": {"replaced_by_report_id"},
    "metrics": {"formula"},
    "requests": {"closed_date", "resulting_report_id", "duplicate_of_request_id"},
}
ENUMS = {
    ("employees", "status"): schemas.EMPLOYEE_STATUS,
    ("reports", "status"): schemas.REPORT_STATUS,
    ("reports", "refresh_status"): schemas.REFRESH_STATUS,
    ("tables", "layer"): schemas.LAYERS,
    ("tables", "update_frequency"): schemas.FREQUENCIES,
    ("table_table_edges", "transform_type"): schemas.TRANSFORMS,
    ("requests", "status"): schemas.REQUEST_STATUS,
}


def _problem(table: str, column: str, kind: str, departments: list[str]) -> Column:
    """The reason a filled cell is bad, or NULL."""
    value = F.col(column)
    if column in ID_COLUMNS:
        prefix = schemas.RECORD_PREFIXES[ID_COLUMNS[column]]
        return F.when(~value.rlike(f"^{prefix}-[0-9]{{3,}}$"), "bad ID")
    if (table, column) in ENUMS:
        return F.when(~value.isin(ENUMS[table, column]), "unknown value")
    if column in DEPARTMENT_COLUMNS:
        return F.when(~value.isin(departments), "unknown value")
    if table == "tables" and column == "name":
        return F.when(~value.rlike(schemas.TABLE_NAME), "bad name")
    if kind == "bigint":
        number = F.expr(f"try_cast(`{column}` AS bigint)")
        return F.when(number.isNull(), "not a number").when(number < 0, "negative")
    if kind == "date":
        return F.when(F.expr(f"try_cast(`{column}` AS date)").isNull(), "not a date")
    if kind == "boolean":
        return F.when(~value.isin("true", "false"), "not true or false")
    return F.lit(None).cast("string")


def check_rows(raw: DataFrame, table: str, departments: list[str]) -> DataFrame:
    """raw string rows with `reasons`: "column: what is wrong", empty for a valid row."""
    tests = []
    for field in schemas.CATALOG[table].fields:
        blank = F.coalesce(F.col(field.name), F.lit("")) == ""
        kind = field.dataType.simpleString()
        bad = _problem(table, field.name, kind, departments)
        empty = F.lit(None).cast("string")
        if field.name not in OPTIONAL.get(table, set()):
            empty = F.lit("empty")
        reason = F.when(blank, empty).otherwise(bad)
        tests.append(
            F.when(reason.isNotNull(), F.concat(F.lit(f"{field.name}: "), reason))
        )
    return raw.withColumn("reasons", F.array_compact(F.array(*tests)))


def valid_rows(checked: DataFrame, table: str) -> DataFrame:
    """The valid rows, typed; blanks are NULL."""
    good = checked.where(F.size("reasons") == 0)
    return good.select(
        [
            F.nullif(F.col(f.name), F.lit("")).cast(f.dataType).alias(f.name)
            for f in schemas.CATALOG[table].fields
        ]
    )


def quarantined_rows(checked: DataFrame) -> DataFrame:
    """The rows that break a rule, with their reasons."""
    return checked.where(F.size("reasons") > 0)
