"""Run files, question files, quota logs and intent files; appending answers once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators.runs import KEY
from quarrylight.sources.staging import stored

STEP = (
    "STRUCT<kind: STRING, name: STRING, arguments: STRING, summary: STRING, duration_ms: INT,"
    " system_chars: BIGINT, tools_chars: BIGINT, results_chars: BIGINT, other_chars: BIGINT>"
)
ANSWER = (
    "STRUCT<answer: STRING, answer_ids: ARRAY<STRING>, evidence_ids: ARRAY<STRING>,"
    " abstained: BOOLEAN>"
)
RUN_LINE = (
    "`set` STRING, config STRING, model STRING, api_version STRING, prompt_version STRING,"
    " frozen_tree_hash STRING, repeat INT, date DATE, item_id STRING, category STRING,"
    " subtype STRING, incomplete BOOLEAN, score STRUCT<correct: BOOLEAN>,"
    f" result STRUCT<stopped_reason: STRING, answer: {ANSWER}, steps: ARRAY<{STEP}>,"
    " stripped_ids: ARRAY<STRING>, tool_calls: INT, input_tokens: INT, output_tokens: INT,"
    " latency_ms: BIGINT>"
)
ITEM = (
    "item_id STRING, category STRING, subtype STRING, question STRING, scoring STRING,"
    " gold STRUCT<answer_ids: ARRAY<STRING>, forbidden_ids: ARRAY<STRING>, should_abstain: BOOLEAN>"
)
QUOTA = "days MAP<STRING, STRUCT<requests: BIGINT, tokens: BIGINT>>, observed_rpd BIGINT"


# A run is written by so many tasks.
TASKS_PER_RUN = 16


def read_run_lines(spark: SparkSession, path: str) -> DataFrame:
    """Run files as flat lines, with the name of the file a line came from."""
    raw = spark.read.schema(RUN_LINE).option("mode", "FAILFAST").json(path)
    file_name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+\.jsonl)", 1)
    return raw.withColumn("file_name", file_name).select(
        "*", F.col("score.correct").alias("correct"), "result.answer.*",
        *[f"result.{c}" for c in ("stopped_reason", "steps", "stripped_ids", "tool_calls",
                                  "input_tokens", "output_tokens", "latency_ms")],
    ).drop("score", "result")


def nest_run_lines(lines: DataFrame, set_name: str) -> DataFrame:
    """Flat lines as the nested records of a run file."""
    answer = F.struct("answer", "answer_ids", "evidence_ids", "abstained")
    result = F.struct(
        "stopped_reason", answer.alias("answer"), "steps", "stripped_ids", "tool_calls",
        "input_tokens", "output_tokens", "latency_ms",
    )
    return lines.select(
        F.lit(set_name).alias("set"), "config", "model", "api_version", "prompt_version",
        "frozen_tree_hash", "repeat", "date", "item_id", "category", "subtype", "incomplete",
        F.struct("correct").alias("score"), result.alias("result"), "file_name",
    )


def read_question_items(spark: SparkSession, path: str) -> DataFrame:
    """Question files {"items": [...]} as one flat row per question."""
    raw = spark.read.schema(f"items ARRAY<STRUCT<{ITEM.replace(' STRING', ': STRING').replace('gold STRUCT', 'gold: STRUCT')}>>").json(path)
    flat = raw.select(F.explode("items").alias("i")).select("i.*")
    return flat.select(
        "item_id", "category", "subtype", "question", "scoring",
        F.col("gold.answer_ids").alias("gold_ids"), F.col("gold.forbidden_ids").alias("forbidden_ids"),
        F.col("gold.should_abstain").alias("should_abstain"),
    )


def read_quota_log(spark: SparkSession, path: str) -> DataFrame:
    """Quota logs as one row per day with the limit the provider was seen to apply."""
    return spark.read.schema(QUOTA).json(path).select(
        F.explode("days").alias("day", "used"), "observed_rpd"
    ).select(F.to_date("day").alias("day"), "used.requests", "used.tokens", "observed_rpd")


def read_intent_map(spark: SparkSession, path: str, field: str) -> DataFrame:
    """One dictionary of the intent files as (key, value) rows."""
    return spark.read.schema(f"`{field}` MAP<STRING, STRING>").json(path).select(
        F.explode(field).alias("key", "value")
    )


def read_intent_lists(spark: SparkSession, path: str, field: str) -> DataFrame:
    """One dictionary of lists (such as chains by code) as (key, pos, value) rows."""
    return spark.read.schema(f"`{field}` MAP<STRING, ARRAY<STRING>>").json(path).select(
        F.explode(field).alias("key", "members")
    ).select("key", F.posexplode("members").alias("pos", "value"))


def append_answers_once(
    spark: SparkSession, path: str, fresh: DataFrame, identity: list[str], order: str
) -> DataFrame:
    """Append the answers whose key the store at `path` does not hold, and return the store.

    Within the new rows the first by `order` counts. Rows of another run identity than the
    store's are refused. Files are partitioned by configuration and repeat.
    """
    first = fresh.groupBy(*KEY).agg(F.min(order).alias(order))
    new = fresh.join(first, [*KEY, order], "left_semi")
    held = stored(spark, path)
    if held is not None:
        foreign = new.select(*identity).distinct().join(
            held.select(*identity).distinct(), identity, "left_anti"
        )
        if not foreign.isEmpty():
            raise ValueError(f"answers of another run: {foreign.first().asDict()}")
        new = new.join(held.select(*KEY), KEY, "left_anti")
    part = F.pmod(F.xxhash64("item_id"), F.lit(TASKS_PER_RUN))
    new.repartition("config", "repeat", part).write.mode("append").partitionBy("config", "repeat").parquet(path)
    return spark.read.parquet(path)
