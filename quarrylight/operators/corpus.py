"""Search documents of the catalog: what is indexed for every asset and request.

doc_id, kind, bm25_text, dense_text, department, status, exact_names. Lexical text repeats
important fields; dense text is readable sentences without record IDs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import is_distinctive, sentences, weighted_text
from quarrylight.sources.catalog import Catalog

COLUMNS_TYPE = "array<struct<name:string,type:string>>"
NO_TEXT = "string"


def report_documents(catalog: Catalog) -> DataFrame:
    tags = F.array_join(F.split("tags", r"\|"), " ")
    listed = F.concat(F.lit("Tags: "), F.array_join(F.split("tags", r"\|"), ", "))
    return catalog.reports.select(
        F.col("report_id").alias("doc_id"), F.lit("report").alias("kind"),
        weighted_text(
            (F.col("report_id"), 1), (F.col("name"), 3), (tags, 2), (F.col("workspace"), 1),
            (F.col("department"), 1), (F.col("description"), 1),
        ).alias("bm25_text"),
        sentences(F.col("name"), F.col("description"), listed).alias("dense_text"),
        "department", "status", F.array("name").alias("exact_names"),
    )


def table_documents(catalog: Catalog) -> DataFrame:
    columns = F.transform(F.from_json("columns_json", COLUMNS_TYPE), lambda c: c["name"])
    owners = catalog.employees.select(F.col("employee_id").alias("owner_id"), "department")
    return catalog.tables.join(owners, "owner_id", "left").select(
        F.col("table_id").alias("doc_id"), F.lit("table").alias("kind"),
        weighted_text(
            (F.col("table_id"), 1), (F.col("name"), 3), (F.col("layer"), 1),
            (F.col("schema_name"), 1), (F.col("source_system"), 1),
            (F.array_join(columns, " "), 1), (F.col("description"), 1),
        ).alias("bm25_text"),
        sentences(F.col("name"), F.col("description")).alias("dense_text"),
        "department", F.lit(None).cast(NO_TEXT).alias("status"),
        F.array("name").alias("exact_names"),
    )


def metric_documents(catalog: Catalog) -> DataFrame:
    aliases = F.split("aliases", r"\|")
    owners = catalog.employees.select(F.col("employee_id").alias("owner_id"), "department")
    return catalog.metrics.join(owners, "owner_id", "left").select(
        F.col("metric_id").alias("doc_id"), F.lit("metric").alias("kind"),
        weighted_text(
            (F.col("metric_id"), 1), (F.col("name"), 3), (F.array_join(aliases, " "), 3),
            (F.col("business_definition"), 1), (F.col("formula"), 1),
        ).alias("bm25_text"),
        sentences(
            F.col("name"), F.col("business_definition"),
            F.concat(F.lit("Tags: "), F.array_join(aliases, ", ")),
        ).alias("dense_text"),
        "department", F.lit(None).cast(NO_TEXT).alias("status"),
        F.concat(F.array("name"), F.filter(aliases, is_distinctive)).alias("exact_names"),
    )


def request_documents(catalog: Catalog) -> DataFrame:
    return catalog.requests.select(
        F.col("request_id").alias("doc_id"), F.lit("request").alias("kind"),
        weighted_text(
            (F.col("request_id"), 1), (F.col("title"), 2), (F.col("description"), 1)
        ).alias("bm25_text"),
        sentences(F.col("title"), F.col("description")).alias("dense_text"),
        "department", "status", F.array().cast("array<string>").alias("exact_names"),
    )


def asset_documents(catalog: Catalog) -> DataFrame:
    return (
        report_documents(catalog)
        .unionByName(table_documents(catalog))
        .unionByName(metric_documents(catalog))
    )
