"""Live views of append-only logs: usage, rates, first answers, accuracy, failure streaks.

Every stateful step has a watermark. Results in append mode go to Parquet files, so a window is written once,
when the watermark has passed its end. `drain` ends a log with closing rows, far enough behind its last event
that the newest windows are written too; a stream that goes on has no such rows and keeps them open.
Results in update mode go to a table by key (`Upserts`), which a replayed trigger does not change.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrylight.functions.scalars import QUOTA_ZONE
from quarrylight.sources.staging import stage, staging_dir

STREAK = 3
#: Days between the last event and the row that closes a finished log; more than any window and delay.
CLOSING = 400
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def follow(spark: SparkSession, directory: str, name: str, ts: str) -> DataFrame:
    """New Parquet files of a table as a stream; the event time is a zoned timestamp."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    stream = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", f"{name}.parquet")
        .option("maxFilesPerTrigger", 64)
        .parquet(directory)
    )
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def drain(
    source: DataFrame, transform: Callable[[DataFrame], DataFrame], name: str, close_after: datetime | None = None, ts: str = "ts"
) -> DataFrame:
    """Run transform(source) over everything available and return what it wrote.

    With `close_after`, a time no event of the source lies behind, the run is ended by a closing row: a second
    run from the same checkpoint reads one row of nulls CLOSING days later, which moves the watermark past every
    open window. The row's own window stays open, so it is never written.
    """
    spark = source.sparkSession
    base = f"{staging_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    closing = f"{base}/closing"
    spark.createDataFrame([], source.schema).coalesce(1).write.parquet(closing)

    def run() -> None:
        rows = source.unionByName(spark.readStream.schema(source.schema).parquet(closing)) if close_after else source
        written = transform(rows).writeStream.format("parquet").outputMode("append")
        query = written.option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    if close_after:
        last = F.lit(close_after + timedelta(days=CLOSING)).cast("timestamp")
        values = [(last if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in source.schema]
        spark.range(1).select(*values).coalesce(1).write.mode("append").parquet(closing)
        run()
    return spark.read.schema(transform(source).schema).parquet(f"{base}/out")


@dataclass
class Upserts:
    """A table by key that a stream in update mode keeps: every trigger's rows are one partition.

    A trigger writes the partition of its number anew, so a trigger that is replayed after a failure changes
    nothing. A key's row is that of the last trigger that held it. `compact` folds partitions into one.
    """

    path: str
    keys: list[str]

    def write(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        stored = spark.read.option("basePath", self.path).parquet(self.path)
        values = [c for c in stored.columns if c not in (*self.keys, "batch")]
        latest = stored.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "batch").alias("_latest"))
        return latest.select(*self.keys, "_latest.*")

    def compact(self, spark: SparkSession, batch_id: int) -> None:
        """Fold everything up to a finished trigger into its partition; the older ones are left empty."""
        stored = spark.read.option("basePath", self.path).parquet(self.path).where(F.col("batch") <= batch_id)
        numbers = [r.batch for r in stored.select("batch").distinct().collect()]
        folded = stage(Upserts.read(self, spark).join(stored.select(*self.keys).distinct(), self.keys, "left_semi"), "folded")
        self.write(folded, batch_id)
        for number in numbers:
            if number != batch_id:
                self.write(folded.limit(0), number)


def keep_updated(stream: DataFrame, table: Upserts, checkpoint: str) -> None:
    """Run a stream in update mode over everything available into a table by key."""
    query = (
        stream.writeStream.outputMode("update").foreachBatch(lambda rows, number: table.write(rows, number))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def hourly_usage(calls: DataFrame, delay: str = "2 hours") -> DataFrame:
    """calls(ts, requests, tokens) -> usage per finished hour of the provider's clock: w, requests, tokens.

    The event time is the provider's local time, so that later windows start at its midnight. When clocks go
    back an hour repeats; the delay covers it.
    """
    local = calls.withColumn("local", F.from_utc_timestamp("ts", QUOTA_ZONE)).withWatermark("local", delay)
    return local.groupBy(F.window("local", "1 hour").alias("w")).agg(
        F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens")
    )


def usage_by_quota_day(hours: DataFrame) -> DataFrame:
    """hourly_usage summed by the provider's day: a second window over the finished hours of the same stream."""
    days = hours.groupBy(F.window(F.window_time("w"), "1 day").alias("d")).agg(
        F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens")
    )
    return days.select(F.to_date("d.start").alias("day"), "requests", "tokens")


def minute_rate(
    calls: DataFrame, max_calls: int, max_tokens: int, delay: str = "1 minute"
) -> DataFrame:
    """Calls and tokens per minute, every ten seconds, flagged above the limits."""
    window = F.window("ts", "60 seconds", "10 seconds").alias("w")
    rates = calls.withWatermark("ts", delay).groupBy(window).agg(
        F.count("*").alias("calls"), F.sum("tokens").alias("tokens")
    )
    over = (F.col("calls") > max_calls) | (F.col("tokens") > max_tokens)
    return rates.select(F.col("w.start").alias("start"), "calls", "tokens", over.alias("over_limit"))


def first_answers(answers: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """One answer per key; repeats within the delay are dropped, state older than it is too."""
    return answers.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def accuracy_by_day(answers: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Answers and correct answers per day, configuration and category."""
    return answers.withWatermark("ts", delay).groupBy(
        F.window("ts", "1 day").alias("w"), "config", "category"
    ).agg(
        F.count("*").alias("n"), F.sum(F.col("correct").cast("int")).alias("right")
    ).select(F.col("w.start").alias("day"), "config", "category", "n", "right")


def running_accuracy(days: DataFrame) -> DataFrame:
    """accuracy_by_day with the accuracy of everything up to each day."""
    so_far = Window.partitionBy("config", "category").orderBy("day").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return days.withColumn(
        "accuracy", F.sum("right").over(so_far) / F.sum("n").over(so_far)
    )


STREAK_OUTPUT = "run string, ts timestamp, streak int"
EPOCH = pd.Timestamp(0, tz="UTC")


class FailureStreaks(StatefulProcessor):
    """Failures in a row per run, in event time.

    State: a list of open answers, those the watermark has not passed, and the streak of the closed ones. A timer
    stands at the earliest open answer. When it fires, every answer up to the watermark is counted in time order
    (of equal times successes first), so answers that came late, in any trigger, stand where they belong. A run
    without open answers and without a streak keeps no state; a streak with no answer for `idle` is
    forgotten, if that is given.
    """

    def __init__(self, idle: timedelta | None = None):
        self.idle_ms = None if idle is None else int(idle.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "at long, failed boolean")
        self.closed = handle.getValueState("closed", "streak int, at long")

    def wait(self, micros: int, extra_ms: int = 0) -> None:
        self.handle.registerTimer(micros // 1000 + 1 + extra_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for batch in rows:
            times = pd.to_datetime(batch["ts"], utc=True)
            at = ((times - EPOCH) // pd.Timedelta(microseconds=1)).astype("int64").tolist()
            failed = [None if pd.isna(f) else bool(f) for f in batch["failed"]]
            if at:
                self.open.appendList(list(zip(at, failed, strict=True)))
                earliest = min([*at, *([earliest] if earliest is not None else [])])
        if earliest is not None:
            self.wait(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        streak, last = self.closed.get() if self.closed.exists() else (0, None)
        answers = sorted(((at, failed) for at, failed in self.open.get()), key=lambda x: (x[0], x[1] is not False, x[1] or False))
        ready = [x for x in answers if x[0] < passed]
        rest, stops = answers[len(ready) :], []
        for at, failed in ready:
            streak, last = (streak + 1 if failed else 0), at
            if streak == STREAK:
                stops.append(at)
        if ready:
            self.open.put(rest) if rest else self.open.clear()
        if rest:
            self.wait(rest[0][0])
        forgotten = self.idle_ms is not None and last is not None and last // 1000 + self.idle_ms < passed // 1000
        if streak == 0 or (forgotten and not rest):
            self.closed.clear()
        else:
            self.closed.update((streak, last))
            if ready and self.idle_ms is not None:
                self.wait(last, self.idle_ms)
        if stops:
            times = EPOCH + pd.to_timedelta(stops, unit="us")
            yield pd.DataFrame({"run": [key[0]] * len(stops), "ts": times, "streak": [STREAK] * len(stops)})

    def close(self) -> None:
        pass


def failure_stops(answers: DataFrame, delay: str = "1 hour", idle: timedelta | None = None) -> DataFrame:
    """answers(run, ts, failed) -> one row whenever a run fails the third time in a row.

    Answers are counted once the watermark has passed them, so rows up to `delay` late give the same stops as
    `failure_stops_batch` on the finished log. Needs the RocksDB state store (`rocksdb_state`).
    """
    watched = answers.withWatermark("ts", delay).select("run", "ts", "failed")
    return watched.groupBy("run").transformWithStateInPandas(
        FailureStreaks(idle), outputStructType=STREAK_OUTPUT, outputMode="Append", timeMode="EventTime"
    )


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's setting is put back afterwards."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before) if before else spark.conf.unset(STATE_STORE)


def failure_stops_batch(answers: DataFrame, slot: str = "HOUR") -> DataFrame:
    """The same stops from a finished log.

    The log is cut into slots of time; failures in a row are counted inside a slot, and a slot
    passes on how many failures it ends with, so no task holds a whole run.
    """
    from_start = Window.partitionBy("run", "slot").orderBy("ts").rowsBetween(
        Window.unboundedPreceding, 0
    )
    failed = F.col("failed").cast("int")
    placed = answers.select("run", "ts", "failed", F.date_trunc(slot, "ts").alias("slot"))
    islands = placed.withColumn("successes", F.sum(1 - failed).over(from_start))
    in_island = Window.partitionBy("run", "slot", "successes").orderBy("ts").rowsBetween(
        Window.unboundedPreceding, 0
    )
    counted = islands.withColumn("inside", F.sum(failed).over(in_island))
    ends = counted.groupBy("run", "slot").agg(
        F.max("successes").alias("all_successes"), F.max_by("inside", "ts").alias("tail")
    )
    earlier = Window.partitionBy("run").orderBy("slot").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sums = ends.withColumn("before", F.coalesce(F.sum("tail").over(earlier), F.lit(0)))
    # Tails count from the last slot with a success on; sums never fall, so its sum is the maximum.
    at_reset = F.max(F.when(F.col("all_successes") > 0, F.col("before"))).over(earlier)
    since = sums.select(
        "run", "slot", (F.col("before") - F.coalesce(at_reset, F.lit(0))).alias("carried")
    )
    joined = counted.join(since, ["run", "slot"])
    carried = F.when(F.col("successes") == 0, F.col("carried")).otherwise(0)
    return joined.where(F.col("failed") & (F.col("inside") + carried == STREAK)).select(
        "run", "ts", F.lit(STREAK).alias("streak")
    )
