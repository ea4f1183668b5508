"""Usage over a rolling window, without one task that holds the whole log or a busy part of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.operators.skew import fan_out_hot_keys, split_hot_keys

#: Parts of a slot. Equal times are one row first, so a part has at most its microseconds as rows.
PARTS = 1000


def usage_at(points: DataFrame, length: int) -> DataFrame:
    """points(at, n, tokens), one per time -> at, calls, window_tokens of the `length` up to each time.

    Time is cut into slots as long as the window and slots into parts. What a window holds is the
    running total of its own slot up to its time, and the previous slot's total without what lies more than
    a window back. Running totals are those of the parts before plus those inside the part, so a window
    partition is one part, or the totals of one slot's parts. A row of zero counts asks for the
    total at the window's start.
    """
    width = -(-length // PARTS)
    own = points.select("at", F.col("at").alias("time"), F.lit(True).alias("own"), "n", "tokens")
    zero = F.lit(0).cast("bigint")
    start = points.select("at", (F.col("at") - length).alias("time"), F.lit(False).alias("own"), zero.alias("n"), zero.alias("tokens"))
    placed = own.union(start).withColumn("slot", F.floor(F.col("time") / length)).withColumn(
        "part", F.floor((F.col("time") - F.col("slot") * length) / width)
    )
    # A start comes before the calls of its time, which its window still holds.
    upto = Window.partitionBy("slot", "part").orderBy("time", "own").rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumn("n_upto", F.sum("n").over(upto)).withColumn("tokens_upto", F.sum("tokens").over(upto))
    parts = placed.groupBy("slot", "part").agg(F.sum("n").alias("n_part"), F.sum("tokens").alias("tokens_part"))
    slot = Window.partitionBy("slot")
    earlier = slot.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.select(
        "slot", "part",
        F.coalesce(F.sum("n_part").over(earlier), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("tokens_part").over(earlier), F.lit(0)).alias("tokens_before"),
        F.sum("n_part").over(slot).alias("n_slot"), F.sum("tokens_part").over(slot).alias("tokens_slot"),
    )

    def share(name: str):
        upto = F.col(f"{name}_before") + F.col(f"{name}_upto")
        return F.sum(F.when(F.col("own"), upto).otherwise(F.col(f"{name}_slot") - upto))

    return inside.join(sums, ["slot", "part"]).groupBy("at").agg(
        share("n").alias("calls"), share("tokens").alias("window_tokens")
    )


def rolling_usage(calls: DataFrame, seconds: int = 60) -> DataFrame:
    """calls(ts, tokens, ...) with `calls` and `window_tokens` of the `seconds` up to each call.

    Both ends of a window belong to it; calls of the same time see each other. Missing tokens count
    as none, a call without time has NULL for both. Calls of one busy time are spread over tasks.
    """
    timed = calls.withColumn("_at", F.unix_micros("ts"))
    points = timed.where("_at IS NOT NULL").groupBy(F.col("_at").alias("at")).agg(
        F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")
    )
    found = usage_at(points, seconds * 1_000_000).withColumnRenamed("at", "_at")
    salted, hot = split_hot_keys(timed, "_at", calls.columns)
    return salted.join(fan_out_hot_keys(found, hot, "_at"), ["_at", "salt"], "left").drop("_at", "salt")


def over_limit(usage: DataFrame, calls: int, tokens: int) -> DataFrame:
    """Calls whose window exceeds the per-minute limits."""
    return usage.where((F.col("calls") > calls) | (F.col("window_tokens") > tokens))
