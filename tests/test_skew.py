import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import quality, similarity, skew
from quarrylight.operators.quality import out_of_order


def test_salted_join_gives_the_plain_join(spark):
    many = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, v int")
    few = spark.createDataFrame([("hot", 1), ("hot", 2), ("k0", 3), ("none", 4)], "k string, w int")
    salted, hot = skew.split_hot_keys(many, "k", ["v"], hot_rows=20)
    assert [r["n_salts"] for r in hot.collect()] == [10]
    assert salted.select("salt").distinct().count() > 1
    joined = skew.fan_out_hot_keys(few, hot, "k").join(salted, ["k", "salt"]).select("k", "v", "w")
    assert sorted(joined.collect()) == sorted(many.join(few, "k").select("k", "v", "w").collect())


def test_similar_names_match_brute_force(spark):
    rng = random.Random(5)
    words = ["sales", "by", "region", "daily", "dealer", "margin", "x1", "x2", "x3", "x4"]
    names = {f"RPT-{i:04d}": " ".join(rng.sample(words, rng.randrange(1, 7))) for i in range(120)}
    df = spark.createDataFrame(list(names.items()), "id string, name string")
    got = {(r["key_a"], r["key_b"]): r["similarity"] for r in similarity.similar_name_pairs(df).collect()}
    sets = sorted({" ".join(sorted(n.split())) for n in names.values()})
    expected = {}
    for i, a in enumerate(sets):
        for b in sets[i + 1 :]:
            x, y = set(a.split()), set(b.split())
            score = len(x & y) / len(x | y)
            if score > 0.6:
                expected[a, b] = pytest.approx(score)
    assert got == expected


def test_out_of_order_sees_block_borders(spark):
    rows = [(f"REQ-{i:04d}", f"2020-01-{d:02d}") for i, d in enumerate([1, 2, 3, 2, 4, 5, 1, 6])]
    df = spark.createDataFrame(rows, "id string, d string").withColumn("d", F.to_date("d"))
    for block in (2, 3, 100):
        got = sorted(r["record"] for r in out_of_order(df, "id", "d", block).collect())
        assert got == ["REQ-0003", "REQ-0006"]


def test_out_of_order_carries_over_empty_blocks_without_one_task(spark, monkeypatch, capsys):
    monkeypatch.setattr(quality, "FAN_IN", 64)
    rng = random.Random(5)
    numbers = sorted(rng.sample(range(100_000), 200))
    rows = [(f"REQ-{n}", date(2020, 1, 1) + timedelta(days=rng.randrange(300))) for n in numbers]
    df = spark.createDataFrame(rows, "id string, d date")
    found = out_of_order(df, "id", "d", 7)
    assert sorted(r["record"] for r in found.collect()) == sorted(
        b[0] for a, b in zip(rows, rows[1:]) if b[1] < a[1]
    )
    found.explain()
    plan = capsys.readouterr().out
    assert "Window" in plan and "SinglePartition" not in plan
