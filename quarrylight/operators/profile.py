"""Profiles of the catalog: sizes, shares, quantiles, structures, noise and sample records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.scalars import packed_list
from quarrylight.functions.text import shorten
from quarrylight.operators.ownership import contacts
from quarrylight.operators.quality import id_number
from quarrylight.operators.selection import quantiles
from quarrylight.operators.skew import value_ranks
from quarrylight.schemas import CATALOG
from quarrylight.sources.catalog import Catalog

COUNTED = [
    ("employees", "status"), ("reports", "status"), ("reports", "refresh_status"),
    ("reports", "department"), ("tables", "layer"), ("tables", "update_frequency"),
    ("requests", "status"),
]
USAGE_QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def counts_share(df: DataFrame, column: str) -> DataFrame:
    """value, n and share of all rows."""
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*")).scalar()
    return counted.withColumn("share", F.col("n") / total)


def value_counts(catalog: Catalog) -> DataFrame:
    """Counts and shares of the catalog's coded columns."""
    parts = [
        counts_share(getattr(catalog, table), column).select(
            F.lit(f"{table}.{column}").alias("field"), "value", "n", "share"
        )
        for table, column in COUNTED
    ]
    return reduce(DataFrame.union, parts)


def department_status(catalog: Catalog) -> DataFrame:
    """Employees by department and status, missing combinations 0."""
    pivoted = catalog.employees.groupBy("department").pivot("status", ["active", "left"]).count()
    return pivoted.fillna(0, ["active", "left"])


def usage_quantiles(catalog: Catalog) -> DataFrame:
    """Interpolated usage quantiles, the maximum and the share of unused active reports."""
    reports = catalog.reports
    rest = reports.agg(
        F.max("usage_30d").alias("max_usage"),
        F.avg(F.when(F.col("status") == "active", (F.col("usage_30d") == 0).cast("int")))
        .alias("unused_share"),
    )
    return quantiles(reports, [], "usage_30d", USAGE_QUANTILES).select(
        "*", rest.select("max_usage").scalar().alias("max_usage"),
        rest.select("unused_share").scalar().alias("unused_share"),
    )


def table_sizes(catalog: Catalog) -> DataFrame:
    parts = [
        getattr(catalog, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        for name in CATALOG
    ]
    return reduce(DataFrame.union, parts)


def structure_table(catalog: Catalog, chains: DataFrame) -> DataFrame:
    """chains(code, chain): how many of each code, their people, and how their walks end."""
    walks = contacts(catalog).select("employee_id", "resolved", F.col("hops").cast("bigint").alias("hops"))
    heads = chains.select("code", F.col("chain")[0].alias("employee_id"),
                          F.size("chain").alias("people"))
    return heads.join(walks, "employee_id").groupBy("code", "resolved", "hops").agg(
        F.count("*").alias("chains"), F.sum("people").alias("people")
    )


def noise_counts(
    catalog: Catalog, pairs: DataFrame, vague: DataFrame, topics: DataFrame, abbreviations: list[str]
) -> DataFrame:
    """The seven kinds of deliberate noise with their counts."""
    reports = catalog.reports
    tagged = F.arrays_overlap(
        packed_list(F.col("tags")), F.array(*[F.lit(a) for a in abbreviations])
    )
    active = F.col("status") == "active"
    counts = {
        "N1": pairs, "N2": reports.where("status = 'deprecated'"), "N3": reports.where(tagged),
        "N4": vague, "N5": reports.where(active & (F.col("refresh_status") == "failed")),
        "N6": topics.select("topic_key").distinct(),
        "N7": catalog.metrics.where("formula IS NULL"),
    }
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(c).alias("code"), "n") for c, df in counts.items()]
    return reduce(DataFrame.union, parts)


def first_middle_last(df: DataFrame, key: str) -> DataFrame:
    """The rows at places 0, n // 2 and n - 1 in the order of their ID numbers."""
    numbered = df.withColumn("_number", id_number(key))
    ranks = value_ranks(numbered, [], "_number")
    wanted = ranks.where(
        (F.col("before") == 0)
        | (F.col("before") == F.floor(F.col("total") / 2))
        | (F.col("before") == F.col("total") - 1)
    ).select("_number")
    return numbered.join(wanted, "_number", "left_semi").drop("_number")


def samples(catalog: Catalog, columns: list[tuple[str, str, str]]) -> DataFrame:
    """First, middle and last record of each table with one text, shortened to 70 characters."""
    parts = [
        first_middle_last(getattr(catalog, table), key).select(
            F.lit(table).alias("table_name"), F.col(key).alias("record"),
            shorten(F.col(text)).alias("text"),
        )
        for table, key, text in columns
    ]
    return reduce(DataFrame.union, parts)
