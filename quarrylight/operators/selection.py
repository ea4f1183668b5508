"""Exact quantiles by selection: ranges are counted, and only the ranges that hold a wanted rank are looked into."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import DataType, DecimalType, FractionalType, IntegralType

from quarrylight.sources.staging import release, stage

#: Ranks of the sketch that proposes cuts are off by one row in so many at most.
ACCURACY = 10_000
#: Cuts of the ranges inside a range.
EVEN = [i / 64 for i in range(1, 64)]
#: Tables of cuts and of ranges up to so many rows are handed to every task; larger ones are joined.
SMALL_ROWS = 10_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL_ROWS else df


def _brackets(fractions: list[float]) -> list[float]:
    """Cuts closely around each wanted fraction, further apart than the sketch can be wrong."""
    around = {f + side * 2 / ACCURACY for f in fractions for side in (-1, 1)}
    return sorted({min(max(f, 0.0), 1.0) for f in around})


def _cuts(rows: DataFrame, kind: DataType, fractions: list[float]) -> DataFrame:
    """Cuts per range. The sketch works on doubles, so whole numbers and decimals count from the lowest value
    of their range: two values that a double cannot tell apart can be told apart there."""
    if isinstance(kind, FractionalType) and not isinstance(kind, DecimalType):
        cuts = F.percentile_approx("_value", fractions, ACCURACY)
    else:
        exact = kind if isinstance(kind, DecimalType) else DecimalType(20, 0)
        above = (F.col("_value").cast(exact) - F.col("_low").cast(exact)).cast("double")
        cuts = F.transform(
            F.percentile_approx(above, fractions, ACCURACY),
            lambda c: (F.col("_low").cast(exact) + c.try_cast(exact)).try_cast(kind),
        )
    per_range = rows.groupBy("_group", "_part", "_low").agg(
        F.array_sort(F.array_distinct(F.array_compact(cuts))).alias("_cuts")
    )
    return per_range.drop("_low")


def _ranged(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows with the number of their range: odd for a cut itself, even for what lies between two cuts."""
    below = F.size(F.filter("_cuts", lambda c: c < F.col("_value")))
    is_cut = F.array_contains("_cuts", F.col("_value")).cast("int")
    return rows.join(cuts, ["_group", "_part"]).withColumn("_range", 2 * below + is_cut).drop("_cuts")


def values_at(rows: DataFrame, fractions: list[float], places) -> tuple[DataFrame, DataFrame]:
    """(totals, answers) for rows(_group, _value) without NULL values.

    totals(_group, total); answers(_group, _place, _value): the value at each 0-based rank in
    places(total), an array column. The first round cuts closely around the fractions, so what is left of
    a group is a few rows in ACCURACY for each; every further round leaves a 64th. A value that is a cut
    has a range of its own, so a value held by half the rows is done in the round that meets it. A
    task keeps a sketch and the counts of at most 129 ranges a group, whatever the rows.
    """
    kind = rows.schema["_value"].dataType
    # Written once, as a round reads its rows three times and the input may be a costly plan.
    rows = live = stage(rows.withColumn("_part", F.lit(0).cast("bigint")).withColumn("_low", F.lit(0).cast(kind)), "values")
    fractions, answers, targets = _brackets(fractions), [], None
    while True:
        cuts = stage(_cuts(rows, kind, fractions), "cuts")
        ranged = _ranged(rows.drop("_low"), _small(cuts, cuts.count()))
        counted = stage(
            ranged.groupBy("_group", "_part", "_range").agg(
                F.count("*").alias("n"), F.min("_value").alias("low"), F.max("_value").alias("high")
            ),
            "ranges",
        )
        if targets is None:
            totals = counted.groupBy("_group").agg(F.sum("n").alias("total"))
            targets = totals.select(
                "_group", F.lit(0).cast("bigint").alias("_part"),
                F.explode(F.array_distinct(places(F.col("total")))).alias("_place"),
            ).withColumn("_rest", F.col("_place"))
        running = Window.partitionBy("_group", "_part").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        before = counted.withColumn("_before", F.coalesce(F.sum("n").over(running), F.lit(0)))
        inside = F.col("_rest").between(F.col("_before"), F.col("_before") + F.col("n") - 1)
        hit = stage(
            targets.join(before, ["_group", "_part"]).where(inside).select(
                "_group", "_part", "_place", "_range", (F.col("_rest") - F.col("_before")).alias("_rest"), "low",
                (F.col("low") == F.col("high")).alias("settled"),
            ),
            "selected",
        )
        answers.append(hit.where("settled").select("_group", "_place", F.col("low").alias("_value")))
        going = hit.where("NOT settled")
        parts = going.select("_group", "_part", "_range", F.col("low").alias("_low")).distinct()
        left = parts.count()
        if not left:
            release(live)
            return totals, reduce(DataFrame.unionByName, answers)
        deeper = (F.col("_part") * (2 * len(fractions) + 1) + F.col("_range")).alias("_part")
        done, live = live, stage(
            ranged.join(_small(parts, left), ["_group", "_part", "_range"]).select("_group", deeper, "_value", "_low"),
            "inside",
        )
        release(done)
        targets = going.select("_group", deeper, "_place", "_rest")
        rows, fractions = live, EVEN


def quantiles(
    df: DataFrame, groups: list[str], value: str, wanted: dict[str, float], nearest: bool = False
) -> DataFrame:
    """Exact quantiles per group, one column per name in `wanted`; NULL values do not count.

    nearest takes the value at index round_half_even(q * (n - 1)); otherwise the two values
    around q * (n - 1) are interpolated. Nothing is sorted and no value table is shuffled: see values_at.
    Groups without values have no row; without groups an empty table gives one row of NULLs.
    """
    # A struct is equal to a struct with the same NULLs, so a NULL group is a group.
    key = F.struct(*[F.col(name) for name in groups]) if groups else F.struct(F.lit(0).alias("all"))
    whole = isinstance(df.schema[value].dataType, IntegralType)
    values = F.col(value).cast("bigint") if whole else F.col(value)
    rows = df.where(F.col(value).isNotNull()).select(key.alias("_group"), values.alias("_value"))

    def places(total: Column) -> Column:
        at = [F.lit(q) * (total - 1) for q in wanted.values()]
        ends = [F.rint(p) for p in at] if nearest else [end(p) for p in at for end in (F.floor, F.ceil)]
        return F.array(*[e.cast("bigint") for e in ends])

    totals, answers = values_at(rows, list(wanted.values()), places)

    def at(place: Column) -> Column:
        return F.max(F.when(F.col("_place") == place.cast("bigint"), F.col("_value").cast("double")))

    columns = []
    for name, q in wanted.items():
        place = F.lit(q) * (F.col("total") - 1)
        if nearest:
            columns.append(at(F.rint(place)).alias(name))
            continue
        low, high = at(F.floor(place)), at(F.ceil(place))
        columns.append((low + F.max(place - F.floor(place)) * (high - low)).alias(name))
    found = totals.join(answers, "_group")
    if not groups:
        return found.agg(*columns)
    return found.groupBy("_group").agg(*columns).select(*[F.col("_group")[name].alias(name) for name in groups], *wanted)
