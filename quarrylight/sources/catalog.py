"""The catalog: seven typed tables, read from CSV or handed over as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.schemas import CATALOG
from quarrylight.sources.staging import stage


@dataclass
class Catalog:
    """Lazily read tables plus derived tables that are built once per session."""

    employees: DataFrame
    reports: DataFrame
    tables: DataFrame
    report_table_edges: DataFrame
    table_table_edges: DataFrame
    metrics: DataFrame
    requests: DataFrame
    built: dict[str, DataFrame] = field(default_factory=dict)
    prepared: dict[str, object] = field(default_factory=dict)

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived table, written to the staging folder the first time it is asked for."""
        if name not in self.built:
            self.built[name] = stage(build(), name)
        return self.built[name]


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One CSV table with its fixed schema; blank cells are NULL, bad headers fail."""
    return (
        spark.read.schema(CATALOG[name])
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("nullValue", "")
        .option("multiLine", True)
        .option("escape", '"')
        .csv(f"{directory}/{name}.csv")
    )


def read_catalog(spark: SparkSession, directory: str) -> Catalog:
    """All seven tables of a directory; a missing directory is reported as such."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(f"no catalog directory at {directory}")
    return Catalog(**{name: read_table(spark, directory, name) for name in CATALOG})


def read_raw_strings(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One CSV table with every column a string and blanks kept as ''."""
    columns = CATALOG[name].fieldNames()
    raw = (
        spark.read.schema(", ".join(f"`{c}` STRING" for c in columns))
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(f"{directory}/{name}.csv")
    )
    return raw.select([F.coalesce(c, F.lit("")).alias(c) for c in columns])


def export_strings(df: DataFrame, name: str) -> DataFrame:
    """The table as it is written: fixed column order, NULL as '', booleans lower case."""
    return df.select(
        [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in CATALOG[name].fieldNames()]
    )


def write_catalog(catalog: Catalog, directory: str, names: Iterable[str] = CATALOG) -> None:
    """Export every table, or those named, as CSV ordered by its key columns (parallel part files)."""
    for name in names:
        schema = CATALOG[name]
        keys = schema.fieldNames()[:2] if name.endswith("_edges") else schema.fieldNames()[:1]
        out = export_strings(getattr(catalog, name), name).orderBy(*keys)
        (
            out.write.option("header", True)
            .option("emptyValue", "")
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
            .csv(f"{directory}/{name}.csv")
        )


def assets(catalog: Catalog) -> DataFrame:
    """Reports, tables and metrics in one shape: id, type, name, owner, status, usage."""
    parts = [
        catalog.reports.select(
            F.col("report_id").alias("asset_id"), F.lit("report").alias("type"), "name",
            "owner_id", "status", F.lit(None).cast("string").alias("layer"),
            F.col("usage_30d").alias("usage_30d"),
        ),
        catalog.tables.select(
            F.col("table_id").alias("asset_id"), F.lit("table").alias("type"), "name",
            "owner_id", F.lit(None).cast("string").alias("status"), "layer",
            F.lit(None).cast("bigint").alias("usage_30d"),
        ),
        catalog.metrics.select(
            F.col("metric_id").alias("asset_id"), F.lit("metric").alias("type"), "name",
            "owner_id", F.lit(None).cast("string").alias("status"),
            F.lit(None).cast("string").alias("layer"),
            F.lit(None).cast("bigint").alias("usage_30d"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def metric_sources(catalog: Catalog) -> DataFrame:
    """One row per metric and source table, from the packed JSON list."""
    return catalog.metrics.select(
        "metric_id",
        F.explode(F.from_json("source_table_ids", "array<string>")).alias("table_id"),
    ).distinct()
