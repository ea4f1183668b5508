"""The seven catalog tables: explicit types, allowed values and ID shapes."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(),
    "BOOLEAN": T.BooleanType(),
    "BIGINT": T.LongType(),
    "DATE": T.DateType(),
}


def _table(*columns: str) -> T.StructType:
    pairs = (column.split() for column in columns)
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


EMPLOYEES = _table(
    "employee_id STRING", "full_name STRING", "department STRING", "title STRING",
    "is_department_head BOOLEAN", "status STRING", "manager_id STRING", "successor_id STRING",
    "start_date DATE", "left_date DATE",
)
REPORTS = _table(
    "report_id STRING", "name STRING", "workspace STRING", "owner_id STRING", "department STRING",
    "description STRING", "created_date DATE", "last_refresh DATE", "refresh_status STRING",
    "tags STRING", "usage_30d BIGINT", "status STRING", "replaced_by_report_id STRING",
)
TABLES = _table(
    "table_id STRING", "name STRING", "layer STRING", "source_system STRING", "schema_name STRING",
    "owner_id STRING", "description STRING", "columns_json STRING", "row_count BIGINT",
    "update_frequency STRING",
)
REPORT_TABLE_EDGES = _table("report_id STRING", "table_id STRING")
TABLE_TABLE_EDGES = _table(
    "parent_table_id STRING", "child_table_id STRING", "transform_type STRING"
)
METRICS = _table(
    "metric_id STRING", "name STRING", "aliases STRING", "business_definition STRING",
    "formula STRING", "source_table_ids STRING", "owner_id STRING",
)
REQUESTS = _table(
    "request_id STRING", "title STRING", "description STRING", "requester_id STRING",
    "assignee_id STRING", "department STRING", "created_date DATE", "closed_date DATE",
    "status STRING", "resulting_report_id STRING", "duplicate_of_request_id STRING",
)

CATALOG = {
    "employees": EMPLOYEES,
    "reports": REPORTS,
    "tables": TABLES,
    "report_table_edges": REPORT_TABLE_EDGES,
    "table_table_edges": TABLE_TABLE_EDGES,
    "metrics": METRICS,
    "requests": REQUESTS,
}

# Allowed words per column.
EMPLOYEE_STATUS = ["active", "left"]
REPORT_STATUS = ["active", "deprecated"]
REFRESH_STATUS = ["success", "failed", "disabled"]
LAYERS = ["staging", "intermediate", "mart"]
FREQUENCIES = ["hourly", "daily", "weekly", "monthly"]
TRANSFORMS = ["clean", "join", "aggregate", "snapshot"]
REQUEST_STATUS = ["done", "duplicate", "open", "rejected", "in_progress"]

# Record types by ID prefix; numbers may have three digits or more.
RECORD_PREFIXES = {
    "employee": "EMP",
    "report": "RPT",
    "table": "TBL",
    "metric": "MET",
    "request": "REQ",
}
RECORD_ID = r"\b(?:EMP|RPT|TBL|MET|REQ)-[0-9]{3,}\b"
TABLE_NAME = "^(stg|int|fct|dim)_[a-z0-9_]+$"
