"""Tables of requests in, tables of answers out: argument checks, record cards, search tools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.config import OUTPUT_CHARS
from quarrylight.functions.text import record_type, snippet
from quarrylight.operators.limits import json_text
from quarrylight.operators.lineage import neighbor_counts
from quarrylight.operators.search import Corpus, search
from quarrylight.sources.catalog import Catalog

# Characters of {"id":"","name":"","layer":""} and a comma: no listed table takes fewer.
ITEM_CHARS = 31
ASSET_KINDS = ["report", "table", "metric"]


def invalid(field: str, problem: str) -> Column:
    return F.struct(
        F.lit("INVALID_ARGUMENT").alias("code"),
        F.lit(f"invalid argument '{field}': {problem}").alias("message"),
    )


def validate_search_args(requests: DataFrame, departments: list[str]) -> DataFrame:
    """Search requests with trimmed text and an error struct naming the first bad argument.

    query 1-300 characters after trimming, asset_type one of the kinds or any, department one of
    the given names or NULL, top_k 1-10.
    """
    text = F.trim("query")
    size = F.length(text)
    error = (
        F.when(size < 1, invalid("query", "too short"))
        .when(size > 300, invalid("query", "too long"))
        .when(~F.col("asset_type").isin(*ASSET_KINDS, "any"), invalid("asset_type", "unknown value"))
        .when(
            F.col("department").isNotNull() & ~F.col("department").isin(*departments),
            invalid("department", "unknown value"),
        )
        .when(~F.col("top_k").between(1, 10), invalid("top_k", "must be 1 to 10"))
    )
    return requests.withColumn("query", text).withColumn("error", error)


def validate_depth(depth: Column) -> Column:
    """Error struct for a lineage depth outside 1-6, else NULL."""
    return F.when(~depth.between(1, 6), invalid("depth", "must be 1 to 6"))


def error_code(kind: Column, allowed_kinds: list[str], found: Column) -> Column:
    """INVALID_ARGUMENT for a wrong kind of ID, NOT_FOUND for an unknown one, else NULL."""
    return F.when(
        kind.isNull() | ~kind.isin(*allowed_kinds), "INVALID_ARGUMENT"
    ).when(~found, "NOT_FOUND")


def known_records(catalog: Catalog) -> DataFrame:
    """record_id and name of every record of the five types."""
    parts = [
        catalog.employees.selectExpr("employee_id AS record_id", "full_name AS name"),
        catalog.reports.selectExpr("report_id AS record_id", "name"),
        catalog.tables.selectExpr("table_id AS record_id", "name"),
        catalog.metrics.selectExpr("metric_id AS record_id", "name"),
        catalog.requests.selectExpr("request_id AS record_id", "title AS name"),
    ]
    return reduce(DataFrame.unionByName, parts)


def lookup_records(catalog: Catalog, requests: DataFrame) -> DataFrame:
    """requests(request_id, record_id) -> kind, name and error; one row per request."""
    known = known_records(catalog).withColumn("found", F.lit(True))
    kind = record_type(F.col("record_id"))
    return requests.join(known, "record_id", "left").select(
        "request_id", "record_id", kind.alias("kind"), "name",
        error_code(
            kind, ["employee", "report", "table", "metric", "request"],
            F.coalesce("found", F.lit(False)),
        ).alias("error"),
    )


def person(catalog: Catalog, prefix: str) -> DataFrame:
    """Person summaries with prefixed columns, ready to be joined in a role."""
    return catalog.employees.select(
        F.col("employee_id").alias(f"{prefix}_id"), F.col("full_name").alias(f"{prefix}_name"),
        F.col("status").alias(f"{prefix}_status"),
    )


def linked_tables(catalog: Catalog, links: DataFrame, key: str) -> DataFrame:
    """key -> linked_count, tables (structs id, name, layer, by ID) and truncated.

    Tables are listed while their JSON fits the payload cap; truncated tells that some did not. An item
    takes ITEM_CHARS at least, which bounds how many of a key's links can fit before any are sorted.
    """
    order = Window.partitionBy(key).orderBy("table_id")
    item = F.struct(F.col("table_id").alias("id"), "name", "layer")
    cards = links.join(catalog.tables.select("table_id", "name", "layer"), "table_id")
    counts = links.groupBy(key).agg(F.count("*").alias("linked_count"))
    able = cards.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= OUTPUT_CHARS // ITEM_CHARS)
    size = F.length(json_text(item)) + 1
    shown = (
        able.withColumn("upto", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("upto") <= OUTPUT_CHARS)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(item)).alias("tables"))
    )
    return counts.join(shown, key, "left").withColumn(
        "truncated", F.coalesce(F.size("tables"), F.lit(0)) < F.col("linked_count")
    )


def report_cards(catalog: Catalog) -> DataFrame:
    """Every report with its owner and its tables."""
    links = linked_tables(catalog, catalog.report_table_edges, "report_id")
    return catalog.reports.join(person(catalog, "owner"), "owner_id", "left").join(
        links, "report_id", "left"
    ).withColumn("tag_list", F.split("tags", r"\|"))


def table_cards(catalog: Catalog, downstream: DataFrame) -> DataFrame:
    """Every table with its owner, parent and child counts and downstream report count.

    downstream(table_id, downstream_report_count) comes from the impact summary.
    """
    return (
        catalog.tables.join(person(catalog, "owner"), "owner_id", "left")
        .join(neighbor_counts(catalog), "table_id")
        .join(downstream, "table_id", "left")
        .fillna({"downstream_report_count": 0})
        .withColumn("columns", F.from_json("columns_json", "array<struct<name:string,type:string>>"))
    )


def metric_cards(catalog: Catalog, links: DataFrame) -> DataFrame:
    """Every metric with its owner and source tables."""
    return catalog.metrics.join(person(catalog, "owner"), "owner_id", "left").join(
        linked_tables(catalog, links, "metric_id"), "metric_id", "left"
    )


def request_cards(catalog: Catalog) -> DataFrame:
    """Every request with requester and assignee: the person table joined in two roles."""
    return catalog.requests.join(person(catalog, "requester"), "requester_id", "left").join(
        person(catalog, "assignee"), "assignee_id", "left"
    )


def asset_cards(catalog: Catalog) -> DataFrame:
    """id, type, name, department, status, replaced_by_report_id, snippet of every asset."""
    owners = catalog.employees.select(F.col("employee_id").alias("owner_id"), "department")
    none = F.lit(None).cast("string")
    reports = catalog.reports.select(
        F.col("report_id").alias("id"), F.lit("report").alias("type"), "name", "department",
        "status", "replaced_by_report_id", snippet(F.col("description")).alias("snippet"),
    )
    tables = catalog.tables.join(owners, "owner_id", "left").select(
        F.col("table_id").alias("id"), F.lit("table").alias("type"), "name", "department",
        none.alias("status"), none.alias("replaced_by_report_id"),
        snippet(F.col("description")).alias("snippet"),
    )
    metrics = catalog.metrics.join(owners, "owner_id", "left").select(
        F.col("metric_id").alias("id"), F.lit("metric").alias("type"), "name", "department",
        none.alias("status"), none.alias("replaced_by_report_id"),
        snippet(F.col("business_definition")).alias("snippet"),
    )
    return reports.union(tables).union(metrics)


def search_cards(catalog: Catalog, hits: DataFrame) -> DataFrame:
    """Ranked hits as typed cards."""
    return hits.join(asset_cards(catalog), hits["doc_id"] == F.col("id")).select(
        "query_id", "id", "type", "name", "department", "status", "replaced_by_report_id",
        "snippet", "rank",
    )


def search_assets(catalog: Catalog, corpus: Corpus, queries: DataFrame, mode: str = "hybrid"):
    """(cards, signal) for a table of asset searches."""
    result = search(queries, corpus, mode)
    return search_cards(catalog, result.hits), result.signal


def find_similar_past_work(catalog: Catalog, corpus: Corpus, queries: DataFrame):
    """(past requests, signal) for a table of descriptions."""
    result = search(queries, corpus)
    work = catalog.requests.select(
        F.col("request_id").alias("doc_id"), "title", "status", "created_date", "closed_date",
        "resulting_report_id", "duplicate_of_request_id",
    )
    hits = result.hits.join(work, "doc_id").select(
        "query_id", F.col("doc_id").alias("request_id"), "title", "status", "created_date",
        "closed_date", "resulting_report_id", "duplicate_of_request_id", "rank",
    )
    return hits, result.signal


def model_view(payload: Column) -> Column:
    """A search payload struct without the echo of the query and the numeric signal fields."""
    return payload.dropFields("query", "signal.top_cosine", "signal.dense_z")
