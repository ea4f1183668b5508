"""Queries over sources, sinks and streams: written, read back and compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarrylight.plans.bindings import DEPARTMENTS, catalog, source
from quarrylight.plans.quality_queries import chains, topics
from quarrylight.plans.registry import query
from quarrylight.plans.run_bindings import answers, items, lines
from quarrylight.plans.run_queries import quota
from quarrylight.schemas import CATALOG
from quarrylight.sources import runs as run_files
from quarrylight.sources.catalog import export_strings, read_catalog, read_raw_strings, write_catalog
from quarrylight.sources.staging import staging_dir
from quarrylight.sources.validation import check_rows
from quarrylight.streaming import streams


def scratch(spark, name: str) -> str:
    return f"{staging_dir(spark)}/files/{name}-{uuid.uuid4().hex}"


def exported(spark, sf, names=tuple(CATALOG)) -> str:
    """The folder of the catalog as CSV; each table is written once per session, when it is first read."""
    cat = catalog(spark, sf)
    path, written = cat.prepared.setdefault("csv", (scratch(spark, "catalog"), set()))
    missing = [name for name in names if name not in written]
    write_catalog(cat, path, missing)
    written.update(missing)
    return path


@query("read_catalog", """
SELECT employee_id AS id, department AS a, status AS b, manager_id AS c, start_date AS day, NULL::BIGINT AS n FROM {employees}
UNION ALL SELECT report_id, name, status, replaced_by_report_id, created_date, usage_30d FROM {reports}
UNION ALL SELECT table_id, name, layer, columns_json, NULL, row_count FROM {tables}
UNION ALL SELECT request_id, title, status, duplicate_of_request_id, closed_date, length(description) FROM {requests}""")
def read_back(spark, sf):
    cat = read_catalog(spark, exported(spark, sf))
    none = "cast(NULL as bigint)"
    return (
        cat.employees.selectExpr("employee_id AS id", "department AS a", "status AS b", "manager_id AS c",
                                 "start_date AS day", f"{none} AS n")
        .union(cat.reports.selectExpr("report_id", "name", "status", "replaced_by_report_id", "created_date", "usage_30d"))
        .union(cat.tables.selectExpr("table_id", "name", "layer", "columns_json", "cast(NULL as date)", "row_count"))
        .union(cat.requests.selectExpr("request_id", "title", "status", "duplicate_of_request_id", "closed_date",
                                       "cast(length(description) as bigint)"))
    )


@query("write_catalog", """
SELECT employee_id, full_name, department, title, CASE WHEN is_department_head THEN 'true' ELSE 'false' END AS is_department_head,
  status, coalesce(manager_id, '') AS manager_id, coalesce(successor_id, '') AS successor_id,
  start_date::VARCHAR AS start_date, coalesce(left_date::VARCHAR, '') AS left_date FROM {employees}""")
def write_back(spark, sf):
    return read_raw_strings(spark, exported(spark, sf), "employees")


@query("read_raw_strings", """
SELECT report_id, name, usage_30d::VARCHAR AS usage_30d, coalesce(replaced_by_report_id, '') AS replaced_by FROM {reports}""")
def raw_strings(spark, sf):
    return read_raw_strings(spark, exported(spark, sf, ["reports"]), "reports").select(
        "report_id", "name", "usage_30d", F.col("replaced_by_report_id").alias("replaced_by")
    )


def flawed_reports(spark, sf):
    """Report rows as strings, some of them broken on purpose."""
    number = F.split("report_id", "-")[1].cast("bigint")
    raw = export_strings(catalog(spark, sf).reports, "reports").withColumn("k", number)
    return raw.withColumns(
        {
            "report_id": F.when(number % 11 == 0, F.concat(F.lit("X"), "report_id")).otherwise(F.col("report_id")),
            "usage_30d": F.when(number % 13 == 0, "-5").when(number % 17 == 0, "many").otherwise(F.col("usage_30d")),
            "created_date": F.when(number % 19 == 0, "2021-02-30").otherwise(F.col("created_date")),
            "status": F.when(number % 23 == 0, "gone").otherwise(F.col("status")),
            "name": F.when(number % 29 == 0, "").otherwise(F.col("name")),
            "department": F.when(number % 31 == 0, "Sales").otherwise(F.col("department")),
        }
    )


@query("validate_rows", """
SELECT k, concat_ws(', ', CASE WHEN k % 11 = 0 THEN 'report_id: bad ID' END, CASE WHEN k % 29 = 0 THEN 'name: empty' END,
  CASE WHEN k % 31 = 0 THEN 'department: unknown value' END, CASE WHEN k % 19 = 0 THEN 'created_date: not a date' END,
  CASE WHEN k % 13 = 0 THEN 'usage_30d: negative' WHEN k % 17 = 0 THEN 'usage_30d: not a number' END,
  CASE WHEN k % 23 = 0 THEN 'status: unknown value' END) AS reasons FROM {reports}""")
def validate_rows(spark, sf):
    checked = check_rows(flawed_reports(spark, sf), "reports", DEPARTMENTS)
    return checked.select("k", F.array_join("reasons", ", ").alias("reasons"))


@query("read_intent_maps", """
SELECT request_id AS key, topic_key AS value, 0::BIGINT AS pos, 'topic' AS field FROM {topics}
UNION ALL SELECT head, unnest(chain), unnest(range(len(chain)))::BIGINT, 'chain' FROM {chains}""")
def intent_maps(spark, sf):
    path = scratch(spark, "intent")
    entry = lambda k, v: F.map_from_arrays(F.array(k), F.array(v))
    topic_maps = topics(spark, sf).select(entry("request_id", "topic_key").alias("request_topic_keys"))
    topic_maps.write.json(f"{path}/topics")
    chain = chains(spark, sf).select(entry(F.col("chain")[0], F.col("chain")).alias("chains"))
    chain.write.json(f"{path}/chains")
    found = run_files.read_intent_map(spark, f"{path}/topics", "request_topic_keys")
    listed = run_files.read_intent_lists(spark, f"{path}/chains", "chains")
    return found.select("key", "value", F.lit(0).cast("bigint").alias("pos"), F.lit("topic").alias("field")).union(
        listed.select("key", "value", F.col("pos").cast("bigint"), F.lit("chain"))
    )


@query("read_run_lines", """
SELECT config, repeat::BIGINT AS repeat, item_id, file_name, correct, array_to_string(answer_ids, ',') AS answer_ids, abstained,
  stopped_reason, latency_ms, (2 + event_id % 4)::BIGINT AS steps, date FROM {lines}""")
def read_run_lines(spark, sf):
    path = scratch(spark, "runs")
    run_files.nest_run_lines(lines(spark, sf), "test").write.partitionBy("file_name").json(path)
    read = run_files.read_run_lines(spark, path)
    return read.select(
        "config", F.col("repeat").cast("bigint"), "item_id",
        F.when(F.col("file_name") == "", "notes.txt").otherwise(F.col("file_name")).alias("file_name"),
        "correct", F.array_join("answer_ids", ",").alias("answer_ids"), "abstained", "stopped_reason",
        "latency_ms", F.size("steps").cast("bigint").alias("steps"), "date",
    )


@query("read_question_items", "SELECT item_id, category, scoring, array_to_string(gold_ids, ',') AS gold_ids, should_abstain FROM {rules}")
def question_items(spark, sf):
    path = scratch(spark, "items")
    one = F.struct(
        "item_id", "category", "subtype", "question", "scoring",
        F.struct(F.col("gold_ids").alias("answer_ids"), "forbidden_ids", "should_abstain").alias("gold"),
    )
    items(spark, sf).select(F.array(one).alias("items")).write.json(path)
    return run_files.read_question_items(spark, path).select(
        "item_id", "category", "scoring", F.array_join("gold_ids", ",").alias("gold_ids"), "should_abstain"
    )


@query("read_quota_log", "SELECT day, requests, tokens, 670::BIGINT AS observed_rpd FROM {quota}")
def quota_log(spark, sf):
    path = scratch(spark, "quota")
    days = F.map_from_arrays(F.array(F.col("day").cast("string")), F.array(F.struct("requests", "tokens")))
    quota(spark, sf).select(days.alias("days"), F.lit(670).alias("observed_rpd")).write.json(path)
    return run_files.read_quota_log(spark, path)


@query("append_answers_once", """
SELECT config, repeat::BIGINT AS repeat, item_id, min(event_id) AS event_id FROM {answers} GROUP BY ALL""")
def append_answers_once(spark, sf):
    path = scratch(spark, "answers")
    made = answers(spark, sf).select("config", "repeat", "item_id", "event_id", "model", "api_version")
    for _ in range(2):  # the second run finds every answer already stored
        stored = run_files.append_answers_once(spark, path, made, ["model", "api_version"], "event_id")
    return stored.select("config", F.col("repeat").cast("bigint"), "item_id", "event_id")


# ------------------------------------------------------------------ streams


def calls(spark, sf):
    return streams.follow(spark, sf, "events", "ts").selectExpr(
        "event_id", "ts", "user_id", "event_type", "value", "1 + event_id % 3 AS requests",
        "100 + event_id % 900 AS tokens",
    )


def last_event(spark, sf):
    """The time of the last event, behind which a finished log is closed."""
    return source(spark, sf, "events").agg(F.max("ts")).first()[0]


@query("stream_quota_by_day", """
SELECT (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles')::DATE AS day, sum(1 + event_id % 3)::BIGINT AS requests,
  sum(100 + event_id % 900)::BIGINT AS tokens FROM events GROUP BY 1""")
def stream_quota_by_day(spark, sf):
    return streams.drain(
        calls(spark, sf), lambda rows: streams.usage_by_quota_day(streams.hourly_usage(rows)), "quota", last_event(spark, sf)
    )


@query("stream_minute_rate", """
SELECT s AS start, count(*)::BIGINT AS calls, sum(tokens)::BIGINT AS tokens, count(*) > 2 OR sum(tokens) > 1500 AS over_limit
FROM (SELECT 100 + event_id % 900 AS tokens, unnest(range(6)) AS i, epoch_us(ts) // 10000000 AS slot, ts FROM events) x,
  LATERAL (SELECT make_timestamp((slot - i) * 10000000) AS s) y GROUP BY 1""")
def stream_minute_rate(spark, sf):
    rates = streams.drain(calls(spark, sf), lambda rows: streams.minute_rate(rows, 2, 1500), "rate", last_event(spark, sf))
    return rates.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_answers_dedup", """
SELECT 'A' || (user_id % 6) AS config, 1 + event_id % 3 AS repeat, event_id // 18 AS item, count(*) > 0 AS kept
FROM events GROUP BY ALL""")
def stream_answers_dedup(spark, sf):
    keyed = calls(spark, sf).selectExpr(
        "ts", "concat('A', user_id % 6) AS config", "1 + event_id % 3 AS repeat", "event_id div 18 AS item"
    )
    kept = streams.drain(keyed, lambda rows: streams.first_answers(rows, ["config", "repeat", "item"], "60 days"), "first")
    return kept.select("config", "repeat", "item", F.lit(True).alias("kept"))


@query("stream_running_accuracy", """
SELECT day, config, category, n, round(sum(r) OVER w / sum(n) OVER w, 6) AS accuracy FROM (
  SELECT ts::DATE AS day, 'A' || (user_id % 6) AS config, event_type AS category, count(*)::BIGINT AS n,
    sum((value >= 30)::INT) AS r FROM events GROUP BY ALL) x
WINDOW w AS (PARTITION BY config, category ORDER BY day)""")
def stream_running_accuracy(spark, sf):
    answered = calls(spark, sf).selectExpr(
        "ts", "concat('A', user_id % 6) AS config", "event_type AS category", "value >= 30 AS correct"
    )
    base = f"{staging_dir(spark)}/streams/accuracy-{uuid.uuid4().hex}"
    days = streams.Upserts(f"{base}/days", ["day", "config", "category"])
    streams.keep_updated(streams.accuracy_by_day(answered), days, f"{base}/checkpoint")
    return streams.running_accuracy(days.read(spark)).select(
        F.to_date("day").alias("day"), "config", "category", "n", F.round("accuracy", 6).alias("accuracy")
    )


_STOPS = """
SELECT run, ts, 3::BIGINT AS streak FROM (SELECT *, row_number() OVER (PARTITION BY run, island ORDER BY ts) AS place FROM (
    SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY run ORDER BY ts) AS island FROM (
      SELECT 'A' || (user_id % 6) AS run, ts, event_type IN ('error', 'purchase') AS failed FROM events) x) y
  WHERE failed) z WHERE place = 3"""


def _attempts(df):
    return df.selectExpr(
        "concat('A', user_id % 6) AS run", "ts", "event_type IN ('error', 'purchase') AS failed"
    )


def _stops(df):
    return df.select("run", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("streak").cast("bigint"))


@query("stream_failure_streak", _STOPS)
def stream_failure_streak(spark, sf):
    with streams.rocksdb_state(spark):
        return _stops(streams.drain(_attempts(calls(spark, sf)), streams.failure_stops, "streak", last_event(spark, sf)))


@query("failure_streak_batch", _STOPS)
def failure_streak_batch(spark, sf):
    log = source(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _stops(streams.failure_stops_batch(_attempts(log)))
