"""Equi-joins whose hot keys are split over several tasks, and exact ranks without one big task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.config import HOT_KEY_ROWS


def salts_for(row_count: Column, hot_rows: int = HOT_KEY_ROWS) -> Column:
    """How many tasks a key with row_count rows is spread over (1 for an ordinary key)."""
    return F.greatest(F.lit(1), F.ceil(row_count / F.lit(hot_rows))).cast("int")


def split_hot_keys(
    many: DataFrame, key: str, spread_by: list[str], hot_rows: int = HOT_KEY_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(many with a `salt` column, hot keys with their number of salts).

    Only keys above hot_rows appear in the second table, so it has at most rows/hot_rows rows.
    """
    hot = (
        many.groupBy(key)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > hot_rows)
        .select(key, salts_for(F.col("_n"), hot_rows).alias("n_salts"))
    )
    salted = (
        many.join(hot, key, "left")
        .withColumn(
            "salt",
            F.pmod(F.xxhash64(*spread_by), F.coalesce("n_salts", F.lit(1))).cast("int"),
        )
        .drop("n_salts")
    )
    return salted, hot


def fan_out_hot_keys(few: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """Copy every row of `few` once per salt of its key, to meet the rows of split_hot_keys."""
    return (
        few.join(hot, key, "left")
        .withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.coalesce("n_salts", F.lit(1)) - 1))
        )
        .drop("n_salts")
    )


def value_ranks(
    df: DataFrame, groups: list[str], value: str, buckets: int = 64
) -> DataFrame:
    """Distinct values per group with `n`, `before` (rows below the value) and `total`.

    Equal values are counted before anything is ordered, then the distinct values are cut into
    buckets at approximate quantiles: each task orders one bucket, and only bucket totals (at
    most `buckets` rows per group) are summed across a group.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(
        F.count("*").alias("n")
    )
    cuts = [i / buckets for i in range(1, buckets)]
    bounds = counted.groupBy(*groups).agg(
        F.percentile_approx(value, cuts, 10_000).alias("_cuts"), F.sum("n").alias("total")
    )
    if groups:
        on = F.lit(True)
        right = bounds
        for name in groups:
            right = right.withColumnRenamed(name, f"_{name}")
            on = on & F.col(name).eqNullSafe(F.col(f"_{name}"))
        placed = counted.join(right, on).drop(*[f"_{name}" for name in groups])
    else:
        cut_row, total_row = bounds.select("_cuts").scalar(), bounds.select("total").scalar()
        placed = counted.withColumn("_cuts", cut_row).withColumn("total", total_row)
    placed = placed.withColumn(
        "_bucket", F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    ).drop("_cuts")
    totals = placed.groupBy(*groups, "_bucket").agg(F.sum("n").alias("_in_bucket"))
    running = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = totals.select(
        *groups, "_bucket", F.coalesce(F.sum("_in_bucket").over(running), F.lit(0)).alias("_start")
    )
    within = Window.partitionBy(*groups, "_bucket").orderBy(value).rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranked = placed.withColumn("_inside", F.coalesce(F.sum("n").over(within), F.lit(0)))
    joined = ranked.join(starts, [*groups, "_bucket"])
    return joined.select(
        *groups, value, "n", (F.col("_start") + F.col("_inside")).alias("before"), "total"
    )
