"""Streams over small logs: closed windows, days of another zone, tables by key, failure streaks."""

import random
import uuid
from collections import Counter
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from quarrylight.sources.staging import staging_dir
from quarrylight.streaming import streams

START = datetime(2024, 11, 2, 20, 0)
SCHEMA = "ts timestamp_ntz, config string, category string, correct boolean, requests long, tokens long"


def log(n, seed=1, hours=60):
    """Events over the night in which the provider's clocks go back."""
    rnd = random.Random(seed)
    return sorted(
        (START + timedelta(seconds=rnd.randint(0, hours * 3600)), f"A{rnd.randint(0, 1)}", "c", rnd.random() < 0.5, 1, rnd.randint(1, 9))
        for _ in range(n)
    )


@pytest.fixture
def folder(spark):
    return f"{staging_dir(spark)}/test-{uuid.uuid4().hex}"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def follow(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def test_quota_days_of_the_provider_with_the_last_one(spark, folder):
    rows = log(300)
    put(spark, folder, rows)
    got = streams.drain(
        follow(spark, folder), lambda r: streams.usage_by_quota_day(streams.hourly_usage(r)), "days", max(r[0] for r in rows)
    ).collect()
    zone, wanted = ZoneInfo("America/Los_Angeles"), Counter()
    for ts, *_, requests, tokens in rows:
        day = ts.replace(tzinfo=ZoneInfo("UTC")).astimezone(zone).date()
        wanted[day] += 1000 * tokens + requests
    assert {r.day: 1000 * r.tokens + r.requests for r in got} == wanted and len(got) == len(wanted)


def test_closed_rates_hold_the_last_windows(spark, folder):
    rows = log(40, hours=1)
    put(spark, folder, rows)
    got = streams.drain(follow(spark, folder), lambda r: streams.minute_rate(r, 2, 20), "rate", max(r[0] for r in rows)).collect()
    wanted = Counter()
    for ts, *_ in rows:
        at = ts - timedelta(seconds=ts.second % 10)
        wanted.update(at - timedelta(seconds=10 * k) for k in range(6))
    assert {r.start: r.calls for r in got} == wanted


def days_of(rows):
    wanted = Counter((r[0].date(), r[1]) for r in rows)
    right = Counter((r[0].date(), r[1]) for r in rows if r[3])
    return {k: (n, right[k]) for k, n in wanted.items()}


def days_in(table, spark):
    return {(r.day.date(), r.config): (r.n, r.right) for r in table.read(spark).collect()}


def test_accuracy_table_by_key_survives_replays(spark, folder):
    rows = log(200)
    table, checkpoint = streams.Upserts(f"{folder}-days", ["day", "config", "category"]), f"{folder}-checkpoint"

    def update():
        streams.keep_updated(streams.accuracy_by_day(follow(spark, folder), "30 days"), table, checkpoint)

    put(spark, folder, rows[:120])
    update()
    assert days_in(table, spark) == days_of(rows[:120])
    # Late rows of days already told and the last, open day arrive in further triggers.
    put(spark, folder, rows[120:])
    put(spark, folder, rows[:30])
    update()
    wanted = days_of(rows + rows[:30])
    assert days_in(table, spark) == wanted
    stored = spark.read.option("basePath", table.path).parquet(table.path)
    numbers = sorted(r.batch for r in stored.select("batch").distinct().collect())
    assert len(numbers) >= 3
    # A trigger that runs again writes what it wrote before.
    for number in numbers:
        again = spark.createDataFrame(stored.where(F.col("batch") == number).drop("batch").collect(), stored.drop("batch").schema)
        table.write(again, number)
        assert days_in(table, spark) == wanted
    table.compact(spark, numbers[-2])
    assert days_in(table, spark) == wanted
    running = streams.running_accuracy(table.read(spark)).where("config = 'A1'").orderBy("day").collect()
    n = right = 0
    for r in running:
        n, right = n + r.n, right + r.right
        assert r.accuracy == pytest.approx(right / n)
    assert n == sum(v[0] for k, v in wanted.items() if k[1] == "A1")


def attempts(n, seed):
    rnd = random.Random(seed)
    return [(START + timedelta(seconds=37 * k + rnd.randint(0, 30)), f"r{rnd.randint(0, 2)}", "c", rnd.random() < 0.4, 1, 1) for k in range(n)]


def stops_of(df):
    return sorted((r.run, r.ts) for r in df.select("run", F.col("ts").cast("timestamp_ntz").alias("ts")).collect())


def test_late_answers_give_the_stops_of_the_finished_log(spark, folder):
    """Answers reach the stream out of order, up to 50 minutes late and in several triggers."""
    rows, rnd = attempts(300, 3), random.Random(5)
    arrival = sorted(rows, key=lambda r: r[0] + timedelta(minutes=rnd.randint(0, 50)))
    for k in range(0, 300, 75):
        put(spark, folder, arrival[k : k + 75])
    named = "config AS run", "ts", "NOT correct AS failed"
    with streams.rocksdb_state(spark):
        got = streams.drain(follow(spark, folder).selectExpr(*named), streams.failure_stops, "streaks", max(r[0] for r in rows))
    log = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp")).selectExpr(*named)
    expected = stops_of(streams.failure_stops_batch(log))
    assert stops_of(got) == expected and len(expected) > 5
    assert spark.conf.get(streams.STATE_STORE, None) != streams.ROCKSDB


def test_an_idle_streak_is_forgotten_when_asked(spark, folder):
    """Two failures, ten days of silence, one more: a stop without idle time, none with one of two days."""
    rows = [(START + timedelta(days=d, minutes=m), "r0", "c", False, 1, 1) for d, m in ((0, 0), (0, 1), (10, 0))]
    other = [(START + timedelta(days=d), "r1", "c", True, 1, 1) for d in range(11)]
    for batch in (rows[:2], other[:6], other[6:], rows[2:]):
        put(spark, folder, batch)
    named = "config AS run", "ts", "NOT correct AS failed"
    found = []
    for idle in (None, timedelta(days=2)):
        with streams.rocksdb_state(spark):
            kept = streams.drain(
                follow(spark, folder).selectExpr(*named), lambda r: streams.failure_stops(r, "1 hour", idle), "idle", rows[2][0]
            )
        found.append(stops_of(kept))
    assert found == [[("r0", rows[2][0])], []]
