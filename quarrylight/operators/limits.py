"""Keeping payloads under a character cap by dropping list items in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def json_text(value: Column) -> Column:
    """JSON with null fields kept, as the cap counts them."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def fit_to_limit(
    fixed: DataFrame,
    items: DataFrame,
    keys: list[str],
    list_order: list[str],
    limit: int,
    min_item_chars: int = 2,
    totals: DataFrame | None = None,
    most_items: Column | None = None,
) -> DataFrame:
    """Which list items stay when the whole payload may have at most `limit` characters.

    fixed(keys, base_chars): payload length with every list empty and truncated false.
    items(keys, cut_order, <list_order columns>, item_chars): lists are cut from the end, the
    list with the lowest cut_order first. Returns the kept items plus `truncated`.

    Dropping an item frees its text and one comma (none for the last one left), and "true" is
    one character shorter than "false", so what stays is the longest prefix, lists in descending
    cut_order, whose running size fits; a payload one character too long loses an item all the same. The total needs only sums; the running size is taken
    over the first limit / min_item_chars items of a list, since no more can ever fit, and the
    rank filter is applied before the shuffle (window group limit). Where items holds only first items of its
    lists, totals(keys, _all) has the characters of all of them, a comma between two of a list, and most_items how many
    of a list can fit.
    """
    most = limit // min_item_chars + 1 if most_items is None else most_items
    if totals is None:
        totals = (
            items.groupBy(*keys, "cut_order")
            .agg((F.sum("item_chars") + F.count("*") - 1).alias("_chars"))
            .groupBy(*keys)
            .agg(F.sum("_chars").alias("_all"))
        )
    in_list = Window.partitionBy(*keys, "cut_order").orderBy(*list_order)
    first = items.withColumn("rank", F.row_number().over(in_list)).where(F.col("rank") <= most)
    in_cut_order = (
        Window.partitionBy(*keys)
        .orderBy(F.desc("cut_order"), "rank")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    cost = F.col("item_chars") + F.when(F.col("rank") > 1, 1).otherwise(0)
    sized = first.withColumn("_run", F.sum(cost).over(in_cut_order))
    over = F.col("base_chars") + F.col("_all") > limit
    return (
        sized.join(totals, keys).join(fixed, keys)
        .withColumn("truncated", over)
        .where(~over | ((F.col("base_chars") - 1 + F.col("_run") <= limit) & (F.col("_run") < F.col("_all"))))
        .drop("_run", "_all", "base_chars")
    )
