import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylight.operators import quota, selection
from quarrylight.operators.quota import rolling_usage
from quarrylight.operators.selection import quantiles

WANTED = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p99": 0.99, "p100": 1.0}


def check(found, values):
    for name, q in WANTED.items():
        assert found[name] == pytest.approx(np.quantile(values, q)), name


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_quantiles_match_numpy(spark, monkeypatch, accuracy):
    # A coarse sketch leaves wide ranges, so further rounds are needed; the values must be the same.
    monkeypatch.setattr(selection, "ACCURACY", accuracy)
    rng = random.Random(1)
    # Half of all rows share one value; the rest has a long tail and a group of its own that is NULL.
    rows = [
        (("a", "b", None)[i % 5 % 3], 7.5 if i % 2 else rng.choice([-1, 1]) * 10 ** rng.uniform(-3, 12))
        for i in range(4000)
    ] + [("gone", None), ("a", None), ("one", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {r["g"]: r for r in quantiles(df, ["g"], "v", WANTED).collect()}
    assert set(found) == {"a", "b", None, "one"}
    for group in found:
        check(found[group], [v for g, v in rows if g == group and v is not None])


def test_whole_numbers_of_any_size_without_groups(spark):
    rng = random.Random(2)
    values = [rng.choice([0, 2**62, -(2**62)]) + rng.randrange(1000) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    ordered = sorted(values)
    got = quantiles(df, [], "v", WANTED, nearest=True).first()
    for name, q in WANTED.items():
        assert got[name] == float(ordered[round(q * (len(values) - 1))])


def test_no_rows(spark):
    empty = spark.createDataFrame([("a", None)], "g string, v bigint")
    assert quantiles(empty, [], "v", WANTED).collect() == [(None,) * len(WANTED)]
    assert quantiles(empty, ["g"], "v", WANTED).collect() == []


def test_a_round_keeps_few_rows_and_the_heavy_value_none(spark, monkeypatch):
    kept, write = [], selection.stage

    def spy(df, name):
        staged = write(df, name)
        if name == "inside":
            kept.append((staged.count(), staged.where("_value = 500000").count()))
        return staged

    monkeypatch.setattr(selection, "stage", spy)
    monkeypatch.setattr(selection, "ACCURACY", 1000)
    df = spark.range(100_000).select(F.when(F.col("id") % 2 == 0, 500_000).otherwise(F.col("id") * 10).alias("v"))
    got = quantiles(df, [], "v", {"p25": 0.25, "p75": 0.75}).first()
    values = [500_000 if i % 2 == 0 else i * 10 for i in range(100_000)]
    assert (got["p25"], got["p75"]) == (np.quantile(values, 0.25), np.quantile(values, 0.75))
    assert kept and all(rows <= 4_000 and heavy == 0 for rows, heavy in kept)


def scan(rows, length):
    return {i: (sum(1 for _, a, _ in rows if s - length <= a <= s), sum(t or 0 for _, a, t in rows if s - length <= a <= s))
            for i, s, _ in rows}


@pytest.mark.parametrize("hot_rows", [None, 5])
def test_rolling_usage_matches_a_scan(spark, monkeypatch, hot_rows):
    if hot_rows:
        split = quota.split_hot_keys
        monkeypatch.setattr(quota, "split_hot_keys", lambda *a: split(*a, hot_rows=hot_rows))
    rng = random.Random(3)
    # Nine tenths of the calls in one slot, many of them at one time; some on the borders and before the epoch.
    times = [rng.randrange(600_000_000, 660_000_000) for _ in range(300)] + [630_000_000] * 60
    times += [rng.randrange(-200_000_000, 1_000_000_000) for _ in range(25)]
    times += [n * 60_000_000 for n in range(-2, 13)]
    rows = [(i, t, None if i % 11 == 0 else rng.randrange(50)) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "id int, us long, tokens int").withColumn("ts", F.timestamp_micros("us"))
    found = rolling_usage(df, 60)
    assert found.columns == [*df.columns, "calls", "window_tokens"]
    assert {r["id"]: (r["calls"], r["window_tokens"]) for r in found.collect()} == scan(rows, 60_000_000)


def test_no_window_holds_more_than_a_part_of_a_slot(spark, capsys):
    points = spark.range(60_000).select((F.col("id") * 1000).alias("at"), F.lit(1).cast("bigint").alias("n"), F.lit(2).cast("bigint").alias("tokens"))
    found = quota.usage_at(points, 60_000_000)
    assert found.agg(F.max("calls"), F.max("window_tokens")).first() == (60_000, 120_000)
    found.explain()
    plan = capsys.readouterr().out
    assert "Window" in plan and "SinglePartition" not in plan


def test_calls_without_time(spark):
    df = spark.createDataFrame([(1, None, 5), (2, 7, 5)], "id int, us long, tokens int").withColumn("ts", F.timestamp_micros("us"))
    got = {r["id"]: (r["calls"], r["window_tokens"]) for r in rolling_usage(df).collect()}
    assert got == {1: (None, None), 2: (1, 5)}
