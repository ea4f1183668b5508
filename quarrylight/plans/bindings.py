"""The driver's tables seen as a catalog: plain arithmetic both Spark and SQL evaluate alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.sources.catalog import Catalog

# The five departments, in the order reports are dealt to them.
DEPARTMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

_CATALOGS: dict[tuple[str, str], Catalog] = {}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_count(df: DataFrame):
    return df.agg(F.count("*")).scalar()


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """One catalog per application and data folder, so derived tables are built once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CATALOGS:
        _CATALOGS[key] = bind(spark, sf_dir)
    return _CATALOGS[key]


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = source(spark, sf_dir, "customer")
    people = (
        customer.withColumn("n", row_count(source(spark, sf_dir, "customer")))
        .selectExpr(
            "c_custkey AS k", "n", "c_name", "c_mktsegment",
            "c_custkey % 3 = 0 AND c_custkey >= 5 AS gone",
        )
        .selectExpr(
            "k",
            "format_string('EMP-%04d', k) AS employee_id",
            "c_name AS full_name",
            "c_mktsegment AS department",
            "CASE k % 4 WHEN 0 THEN 'Analyst' WHEN 1 THEN 'Engineer' WHEN 2 THEN 'Manager'"
            " ELSE 'Planner' END AS title",
            "CASE WHEN gone THEN 'left' ELSE 'active' END AS status",
            "CASE WHEN k % 45 = 0 THEN NULL ELSE format_string('EMP-%04d', k div 10) END"
            " AS manager_id",
            "CASE WHEN NOT gone THEN NULL"
            " WHEN k % 66 = 33 AND k + 6 < n THEN format_string('EMP-%04d', k + 6)"
            " WHEN k % 66 = 39 THEN format_string('EMP-%04d', k - 6)"
            " WHEN k % 2 = 1 THEN format_string('EMP-%04d', (k * 7 + 3) % n) END AS successor_id",
            "date_add(DATE'2010-01-01', cast(k % 3000 as int)) AS start_date",
            "CASE WHEN gone THEN date_add(DATE'2010-01-01', cast(k % 3000 + 30 + k % 700 as int))"
            " END AS left_date",
        )
    )
    heads = (
        people.where("status = 'active'").groupBy("department").agg(F.min("k").alias("head_k"))
    )
    return people.join(F.broadcast(heads), "department", "left").selectExpr(
        "employee_id", "full_name", "department", "title",
        "coalesce(k = head_k, false) AS is_department_head",
        "status", "manager_id", "successor_id", "start_date", "left_date",
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = source(spark, sf_dir, "orders")
    segments = ", ".join(f"'{d}'" for d in DEPARTMENTS)
    return (
        orders.withColumn("n", row_count(source(spark, sf_dir, "orders")))
        .selectExpr(
            "o_orderkey AS k", "n", "o_custkey", "o_orderstatus", "o_totalprice",
            "to_date(o_orderdate) AS day",
            "lower(substring(o_orderpriority, 3)) AS word",
            f"element_at(array({segments}), cast(o_orderkey % 5 + 1 as int)) AS seg",
        )
        .selectExpr(
            "format_string('RPT-%04d', k) AS report_id",
            "concat(word, ' ', lower(seg), ' view x', k div 3, ' y', k div 2) AS name",
            "concat(lower(seg), ' workspace') AS workspace",
            "format_string('EMP-%04d', o_custkey) AS owner_id",
            "seg AS department",
            "concat('Order value ', cast(floor(o_totalprice) as bigint), ' by ', lower(seg), '.')"
            " AS description",
            "day AS created_date",
            "date_add(day, cast(k % 90 as int)) AS last_refresh",
            "CASE WHEN o_orderstatus = 'P' THEN 'disabled' WHEN k % 17 = 0 THEN 'failed'"
            " ELSE 'success' END AS refresh_status",
            "concat(word, '|', lower(seg)) AS tags",
            "cast(floor(o_totalprice) as bigint) AS usage_30d",
            "CASE WHEN o_orderstatus = 'P' THEN 'deprecated' ELSE 'active' END AS status",
            "CASE WHEN o_orderstatus = 'P' THEN format_string('RPT-%04d', (k + 1) % n) END"
            " AS replaced_by_report_id",
        )
    )


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = source(spark, sf_dir, "part")
    return (
        part.withColumn("n", row_count(source(spark, sf_dir, "customer")))
        .selectExpr(
            "p_partkey AS k", "n", "p_name", "p_brand", "p_type", "p_retailprice",
            "element_at(array('staging', 'intermediate', 'mart'), cast(p_partkey % 3 + 1 as int))"
            " AS layer",
            "element_at(array('stg', 'int', 'dim'), cast(p_partkey % 3 + 1 as int)) AS prefix",
        )
        .selectExpr(
            "format_string('TBL-%04d', k) AS table_id",
            "concat(prefix, '_', replace(p_name, ' ', '_'), '_', k) AS name",
            "layer",
            "lower(p_type) AS source_system",
            "concat('s_', lower(replace(p_brand, '#', ''))) AS schema_name",
            "format_string('EMP-%04d', (k * 13 + 5) % n) AS owner_id",
            "concat(p_name, ' of ', p_brand, '.') AS description",
            "CASE k % 4"
            " WHEN 0 THEN '[{\"name\":\"order_id\",\"type\":\"string\"}]'"
            " WHEN 1 THEN '[{\"name\":\"is_open\",\"type\":\"boolean\"},"
            "{\"name\":\"ship_date\",\"type\":\"date\"}]'"
            " WHEN 2 THEN '[{\"name\":\"part_key\",\"type\":\"integer\"},"
            "{\"name\":\"unit_price\",\"type\":\"decimal(18,2)\"},"
            "{\"name\":\"loaded_at\",\"type\":\"timestamp\"}]'"
            " ELSE '[{\"name\":\"rating_score\",\"type\":\"decimal(5,2)\"},"
            "{\"name\":\"labour_hours\",\"type\":\"decimal(9,2)\"}]' END AS columns_json",
            "cast(floor(p_retailprice * 100) as bigint) AS row_count",
            "element_at(array('hourly', 'daily', 'weekly', 'monthly'), cast(k % 4 + 1 as int))"
            " AS update_frequency",
        )
    )


def table_table_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = source(spark, sf_dir, "part").where("p_partkey > 0")
    halves = part.selectExpr("p_partkey div 2 AS parent", "p_partkey AS child")
    thirds = part.selectExpr("p_partkey div 3 AS parent", "p_partkey AS child")
    return halves.union(thirds).distinct().selectExpr(
        "format_string('TBL-%04d', parent) AS parent_table_id",
        "format_string('TBL-%04d', child) AS child_table_id",
        "element_at(array('clean', 'join', 'aggregate', 'snapshot'),"
        " cast((parent + child) % 4 + 1 as int)) AS transform_type",
    )


def report_table_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        source(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
        .selectExpr(
            "format_string('RPT-%04d', l_orderkey) AS report_id",
            "format_string('TBL-%04d', l_partkey) AS table_id",
        )
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = source(spark, sf_dir, "supplier")
    return (
        supplier.withColumn("n", row_count(source(spark, sf_dir, "customer")))
        .withColumn("p", row_count(source(spark, sf_dir, "part")))
        .withColumnRenamed("s_suppkey", "k")
        .selectExpr(
            "format_string('MET-%04d', k) AS metric_id",
            "lower(replace(s_name, '#', ' ')) AS name",
            "concat_ws('|', concat('S', k), concat('gross balance ', k),"
            " concat('nation', s_nationkey)) AS aliases",
            "concat('Balance of ', s_name) AS business_definition",
            "CASE WHEN k % 7 <> 0 THEN concat('sum(balance_', k, ')') END AS formula",
            "to_json(array_sort(array_distinct(transform("
            "slice(array((k * 17 + 1) % p, (k * 31 + 5) % p, (k * 7 + 2) % p), 1,"
            " cast(k % 3 + 1 as int)),"
            " x -> format_string('TBL-%04d', x))))) AS source_table_ids",
            "format_string('EMP-%04d', (k * 11 + 6) % n) AS owner_id",
        )
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = source(spark, sf_dir, "documents")
    return (
        documents.withColumn("n", row_count(source(spark, sf_dir, "customer")))
        .withColumn("r", row_count(source(spark, sf_dir, "orders")))
        .withColumnRenamed("doc_id", "k")
        .selectExpr(
            "*",
            "element_at(array('done', 'done', 'done', 'done', 'done', 'duplicate', 'open',"
            " 'rejected', 'in_progress', 'done'), cast(k % 10 + 1 as int)) AS status",
            "date_add(DATE'2020-01-01', cast(k % 700 as int)) AS created_date",
        )
        .selectExpr(
            "format_string('REQ-%04d', k) AS request_id",
            "split(text, '\\n')[0] AS title",
            "text AS description",
            "format_string('EMP-%04d', (k * 3) % n) AS requester_id",
            "format_string('EMP-%04d', (k * 7 + 1) % n) AS assignee_id",
            "lang AS department",
            "created_date",
            "CASE WHEN status IN ('done', 'duplicate')"
            " THEN date_add(created_date, cast(n_chars % 90 as int)) END AS closed_date",
            "status",
            "CASE WHEN status = 'done' AND k % 4 <> 0"
            " THEN format_string('RPT-%04d', (k * 5) % r) END AS resulting_report_id",
            "CASE WHEN status = 'duplicate' THEN format_string('REQ-%04d', k - 1) END"
            " AS duplicate_of_request_id",
        )
    )


def bind(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(
        employees=employees(spark, sf_dir),
        reports=reports(spark, sf_dir),
        tables=tables(spark, sf_dir),
        report_table_edges=report_table_edges(spark, sf_dir),
        table_table_edges=table_table_edges(spark, sf_dir),
        metrics=metrics(spark, sf_dir),
        requests=requests(spark, sf_dir),
    )
