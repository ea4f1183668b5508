import hashlib
import math

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import runs


def weight(draw):
    """How often a question is drawn for a draw out of 2^32, from the distribution's own sums."""
    below = 0.0
    for count in range(13):
        below += math.exp(-1) / math.factorial(count)
        if draw < int(below * 2**32):
            return count
    return 13


def brute(means, samples, seed):
    values = []
    for b in range(samples):
        drawn = []
        for item, mean in means:
            digits = hashlib.md5(f"{seed}:{b // 4}:{item}".encode()).hexdigest()
            drawn.append((weight(int(digits[8 * (b % 4) : 8 * (b % 4) + 8], 16)), mean))
        if sum(w for w, _ in drawn):
            values.append(sum(w * m for w, m in drawn) / sum(w for w, _ in drawn))
    values.sort()
    return values[int(0.025 * samples)], values[int(0.975 * samples) - 1]


@pytest.mark.parametrize("samples", [10, 41, 200])
def test_every_resample_asked_for_is_drawn(spark, samples):
    means = [(f"q{n}", (n * 37 % 11) / 10) for n in range(25)]
    df = spark.createDataFrame(means, "item_id string, mean double").withColumn("config", F.lit("A0"))
    row = runs.bootstrap_ci(df, ["config"], samples, seed=3).first()
    assert (row["low"], row["high"]) == pytest.approx(brute(means, samples, 3))


def test_weights_reach_the_end_of_the_distribution(spark):
    draws = [0, 2**31, 2**32 - 2**20, 2**32 - 2, 2**32 - 1]
    df = spark.createDataFrame([(d, f"{d:08x}") for d in draws], "draw long, digits string")
    got = [(r["draw"], r["w"]) for r in df.select("draw", runs.poisson_weight(F.col("digits")).alias("w")).collect()]
    assert sorted(got) == [(d, weight(d)) for d in draws]
    assert max(w for _, w in got) > 9
