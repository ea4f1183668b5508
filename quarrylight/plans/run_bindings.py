"""Evaluation items and run lines derived from the event table, in Spark and in SQL.

Eighteen events in a row belong to one question. An event is one answer of a configuration
(by user) in a repeat (by event); the first answer per configuration, repeat and question counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import scoring
from quarrylight.plans.bindings import catalog, source
from quarrylight.plans.oracle_views import view

# Question categories and configurations of the plan.
CATEGORIES = ["L1", "L2", "L3", "L4", "L5", "L6", "MX"]
CONFIGS = ["A0", "A1", "A2", "A3", "A4", "A5"]
TOOLS = [
    "search_assets", "get_record", "resolve_owner", "trace_lineage", "find_similar_past_work",
    "impact_analysis",
]


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per question with its gold answer and scoring rule."""
    numbers = source(spark, sf_dir, "events").selectExpr("event_id div 18 AS i").distinct()
    base = numbers.selectExpr(
        "i",
        "format_string('ITM-%05d', i) AS item_id",
        "element_at(array('L1', 'L2', 'L3', 'L4', 'L5', 'L6', 'MX'), cast(i % 7 + 1 as int))"
        " AS category",
        "element_at(array('individual', 'broadcast', 'metric_owners'), cast(i div 7 % 3 + 1 as int))"
        " AS subtype",
        "element_at(array('RPT', 'EMP', 'TBL', 'REQ', 'EMP', 'EMP', 'MET'), cast(i % 7 + 1 as int))"
        " AS prefix",
        "CASE i % 7 WHEN 0 THEN 'asset_by_description' WHEN 1 THEN 'current_contact_for_asset'"
        " WHEN 2 THEN CASE WHEN i % 2 = 0 THEN 'upstream_tables' ELSE 'downstream_reports' END"
        " WHEN 3 THEN 'similar_requests' WHEN 4 THEN 'impact_notify' WHEN 5 THEN 'abstain'"
        " ELSE 'chain' END AS gold_type",
        "format_string('TBL-%04d', i % 1000) AS node_id",
        "cast(1 + i % 4 as int) AS depth",
    ).selectExpr(
        "*",
        "CASE WHEN category = 'L6' THEN cast(array() as array<string>) ELSE"
        " transform(sequence(0, cast(i div 7 % 4 as int)),"
        " j -> format_string('%s-%04d', prefix, (i * 7 + j * 13) % 9973)) END AS gold_ids",
        "CASE WHEN i % 2 = 0 AND category <> 'L6'"
        " THEN array(format_string('%s-%04d', prefix, (i * 7 + 500) % 9973))"
        " ELSE cast(array() as array<string>) END AS forbidden_ids",
        "category = 'L6' AS should_abstain",
    )
    return base.select(
        "*",
        scoring.scoring_rule(F.col("category"), F.col("subtype"), F.size("gold_ids")).alias("scoring"),
        F.expr(
            "concat('question ', i, CASE WHEN i % 10 = 3 AND size(gold_ids) > 0"
            " THEN concat(' on ', gold_ids[0]) ELSE '' END)"
        ).alias("question"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as an answer to its question, repeats of the same key included."""
    events = source(spark, sf_dir, "events")
    made = events.selectExpr(
        "event_id", "user_id", "event_type", "value", "cast(ts as timestamp) AS ts",
        "event_id div 18 AS i",
        "concat('A', user_id % 6) AS config",
        "cast(1 + event_id % 3 as int) AS repeat",
    ).join(items(spark, sf_dir), "i")
    return made.selectExpr(
        "event_id", "user_id", "ts", "i", "config", "repeat", "item_id", "category", "subtype",
        "event_type = 'error' AS abstained",
        "to_date(ts) AS date",
        "'m1' AS model", "'v1' AS api_version",
        "CASE WHEN user_id % 10 = 3 THEN 'p2' ELSE 'p1' END AS prompt_version",
        "CASE WHEN i % 3 = 0 THEN 'old' ELSE 'new' END AS frozen_tree_hash",
        "event_id % 50 = 0 AS incomplete",
        "CASE WHEN user_id = 13 THEN 'test_A9_r1.jsonl' WHEN user_id = 14 THEN 'notes.txt'"
        " ELSE concat('test_', 'A', user_id % 6, '_r', 1 + event_id % 3, '.jsonl') END AS file_name",
        "CASE WHEN event_type = 'error' AND event_id % 3 <> 0 THEN cast(array() as array<string>)"
        " ELSE concat("
        "  CASE WHEN event_id % 4 = 1 AND size(gold_ids) > 0"
        "   THEN slice(gold_ids, 1, size(gold_ids) - 1) ELSE gold_ids END,"
        "  CASE WHEN event_id % 5 = 2 THEN array(concat(prefix, '-9990')) ELSE cast(array() as array<string>) END,"
        "  CASE WHEN event_id % 7 = 3 THEN forbidden_ids ELSE cast(array() as array<string>) END)"
        " END AS answer_ids",
        "array(node_id) AS evidence_ids",
        "concat('see ', node_id, CASE WHEN event_id % 6 = 0 THEN ' and RPT-9999' ELSE '' END)"
        " AS answer",
        "CASE event_type WHEN 'signup' THEN 'tool_budget' WHEN 'purchase' THEN 'parse_failure'"
        " ELSE 'final' END AS stopped_reason",
        "cast((2 + event_id % 4) div 2 as int) AS tool_calls",
        "cast(100 + event_id % 900 as int) AS input_tokens",
        "cast(10 + event_id % 90 as int) AS output_tokens",
        "cast(floor(value * 1000) as bigint) AS latency_ms",
        "CASE WHEN event_id % 9 = 4 THEN array('RPT-9999') ELSE cast(array() as array<string>) END"
        " AS stripped_ids",
        "transform(sequence(0, cast(1 + event_id % 4 as int)), pos -> named_struct("
        "  'kind', CASE WHEN pos % 2 = 0 THEN 'llm' ELSE 'tool' END,"
        "  'name', CASE WHEN pos % 2 = 1 THEN element_at(array('search_assets', 'get_record',"
        "   'resolve_owner', 'trace_lineage', 'find_similar_past_work', 'impact_analysis'),"
        "   cast((event_id div 4 + pos) % 6 + 1 as int)) END,"
        "  'arguments', CASE WHEN pos % 2 = 1 THEN CASE WHEN (event_id div 4 + pos) % 6 = 5"
        "   THEN concat('{\"table_id\":\"', node_id, '\"}')"
        "   ELSE concat('{\"node_id\":\"', node_id, '\",\"direction\":\"',"
        "    CASE WHEN event_id % 2 = 0 THEN 'upstream' ELSE 'downstream' END,"
        "    '\",\"depth\":', depth, '}') END END,"
        "  'summary', CASE WHEN pos % 2 = 0 THEN 'thought'"
        "   WHEN (event_id + pos) % 11 = 0 THEN 'error: BUDGET'"
        "   WHEN (event_id + pos) % 13 = 0 THEN 'error: NOT_FOUND'"
        "   WHEN size(gold_ids) > 0 AND event_id % 3 <> 0 THEN concat('found ', gold_ids[0])"
        "   ELSE concat('found ', node_id) END,"
        "  'duration_ms', cast((event_id * 37 + pos * 101) % 900 as int),"
        "  'system_chars', cast(1000 + i % 7 as bigint), 'tools_chars', cast(800 as bigint),"
        "  'results_chars', cast(pos * 150 + event_id % 50 as bigint),"
        "  'other_chars', cast(60 + i % 40 as bigint))) AS steps",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run lines: first answer per configuration, repeat and question, with stored scores.

    Answers of user 7 carry a wrong stored score on purpose.
    """
    cat = catalog(spark, sf_dir)

    def build() -> DataFrame:
        made = answers(spark, sf_dir)
        first = made.groupBy("config", "repeat", "item_id").agg(F.min("event_id").alias("event_id"))
        kept = made.join(first.select("event_id"), "event_id", "left_semi")
        scored = scoring.score_answers(kept, items(spark, sf_dir))
        return scored.withColumn(
            "correct", F.when(F.col("user_id") == 7, ~F.col("correct")).otherwise(F.col("correct"))
        )

    return cat.once("lines", build)


view("items", """
  SELECT *, CASE WHEN category = 'L6' THEN []::VARCHAR[] ELSE list_transform(range(0, i // 7 % 4 + 1),
      lambda j: prefix || '-' || printf('%04d', (i * 7 + j * 13) % 9973)) END AS gold_ids,
    CASE WHEN i % 2 = 0 AND category <> 'L6'
      THEN [prefix || '-' || printf('%04d', (i * 7 + 500) % 9973)] ELSE []::VARCHAR[] END AS forbidden_ids,
    category = 'L6' AS should_abstain
  FROM (SELECT DISTINCT event_id // 18 AS i, printf('ITM-%05d', event_id // 18) AS item_id,
      ['L1', 'L2', 'L3', 'L4', 'L5', 'L6', 'MX'][event_id // 18 % 7 + 1] AS category,
      ['individual', 'broadcast', 'metric_owners'][event_id // 18 // 7 % 3 + 1] AS subtype,
      ['RPT', 'EMP', 'TBL', 'REQ', 'EMP', 'EMP', 'MET'][event_id // 18 % 7 + 1] AS prefix,
      CASE event_id // 18 % 7 WHEN 0 THEN 'asset_by_description' WHEN 1 THEN 'current_contact_for_asset'
        WHEN 2 THEN CASE WHEN event_id // 18 % 2 = 0 THEN 'upstream_tables' ELSE 'downstream_reports' END
        WHEN 3 THEN 'similar_requests' WHEN 4 THEN 'impact_notify' WHEN 5 THEN 'abstain'
        ELSE 'chain' END AS gold_type,
      printf('TBL-%04d', event_id // 18 % 1000) AS node_id, 1 + event_id // 18 % 4 AS depth
    FROM events) x""")
view("rules", """
  SELECT *, CASE WHEN category = 'L6' THEN 'abstain'
      WHEN category = 'L4' THEN 'contains_any'
      WHEN category IN ('L1', 'L2') THEN 'contains_all'
      WHEN len(gold_ids) = 1 THEN 'contains_all'
      WHEN category = 'L3' THEN 'set_f1'
      WHEN category = 'L5' AND subtype = 'individual' THEN 'set_f1'
      WHEN category = 'MX' AND subtype = 'metric_owners' THEN 'set_f1'
      ELSE 'contains_all' END AS scoring,
    'question ' || i || CASE WHEN i % 10 = 3 AND len(gold_ids) > 0 THEN ' on ' || gold_ids[1] ELSE '' END
      AS question
  FROM {items}""")
view("answers", """
  SELECT e.event_id, e.user_id, e.ts, e.event_type, i.*, 'A' || (user_id % 6) AS config,
    1 + event_id % 3 AS repeat, event_type = 'error' AS abstained, ts::DATE AS date,
    CASE WHEN user_id % 10 = 3 THEN 'p2' ELSE 'p1' END AS prompt_version,
    CASE WHEN i.i % 3 = 0 THEN 'old' ELSE 'new' END AS frozen_tree_hash,
    event_id % 50 = 0 AS incomplete,
    CASE WHEN user_id = 13 THEN 'test_A9_r1.jsonl' WHEN user_id = 14 THEN 'notes.txt'
      ELSE 'test_A' || (user_id % 6) || '_r' || (1 + event_id % 3) || '.jsonl' END AS file_name,
    CASE WHEN event_type = 'error' AND event_id % 3 <> 0 THEN []::VARCHAR[] ELSE list_concat(list_concat(
      CASE WHEN event_id % 4 = 1 AND len(gold_ids) > 0 THEN gold_ids[1:len(gold_ids) - 1] ELSE gold_ids END,
      CASE WHEN event_id % 5 = 2 THEN [prefix || '-9990'] ELSE []::VARCHAR[] END),
      CASE WHEN event_id % 7 = 3 THEN forbidden_ids ELSE []::VARCHAR[] END) END AS answer_ids,
    [node_id] AS evidence_ids,
    'see ' || node_id || CASE WHEN event_id % 6 = 0 THEN ' and RPT-9999' ELSE '' END AS answer,
    CASE event_type WHEN 'signup' THEN 'tool_budget' WHEN 'purchase' THEN 'parse_failure'
      ELSE 'final' END AS stopped_reason,
    (2 + event_id % 4) // 2 AS tool_calls, 100 + event_id % 900 AS input_tokens,
    10 + event_id % 90 AS output_tokens, floor(value * 1000)::BIGINT AS latency_ms,
    CASE WHEN event_id % 9 = 4 THEN ['RPT-9999'] ELSE []::VARCHAR[] END AS stripped_ids
  FROM events e JOIN {rules} i ON i.i = e.event_id // 18""")
view("steps", """
  SELECT *, CASE WHEN pos % 2 = 0 THEN 'llm' ELSE 'tool' END AS kind,
    CASE WHEN pos % 2 = 1 THEN ['search_assets', 'get_record', 'resolve_owner', 'trace_lineage',
      'find_similar_past_work', 'impact_analysis'][(event_id // 4 + pos) % 6 + 1] END AS name,
    CASE WHEN pos % 2 = 1 THEN CASE WHEN (event_id // 4 + pos) % 6 = 5
      THEN '{"table_id":"' || node_id || '"}'
      ELSE '{"node_id":"' || node_id || '","direction":"' || CASE WHEN event_id % 2 = 0 THEN 'upstream'
        ELSE 'downstream' END || '","depth":' || depth || '}' END END AS arguments,
    CASE WHEN pos % 2 = 0 THEN 'thought' WHEN (event_id + pos) % 11 = 0 THEN 'error: BUDGET'
      WHEN (event_id + pos) % 13 = 0 THEN 'error: NOT_FOUND'
      WHEN len(gold_ids) > 0 AND event_id % 3 <> 0 THEN 'found ' || gold_ids[1]
      ELSE 'found ' || node_id END AS summary,
    (event_id * 37 + pos * 101) % 900 AS duration_ms, 1000 + i % 7 AS system_chars,
    800 AS tools_chars, pos * 150 + event_id % 50 AS results_chars, 60 + i % 40 AS other_chars
  FROM (SELECT *, unnest(range(0, 2 + event_id % 4)) AS pos FROM {lines}) x""")
view("scored", """
  SELECT *, len(list_distinct(list_intersect(answer_ids, gold_ids))) AS tp,
    len(list_distinct(answer_ids)) AS n_given, len(gold_ids) AS n_gold FROM {answers}
  WHERE event_id IN (SELECT min(event_id) FROM {answers} GROUP BY config, repeat, item_id)""")
view("lines", """
  SELECT *, CASE WHEN user_id = 7 THEN NOT fresh ELSE fresh END AS correct FROM (
    SELECT *, CASE scoring
      WHEN 'contains_all' THEN NOT abstained AND tp = n_gold AND NOT list_has_any(answer_ids, forbidden_ids)
      WHEN 'contains_any' THEN NOT abstained AND tp > 0
      WHEN 'set_f1' THEN NOT abstained AND n_given + n_gold > 0 AND 2.0 * tp / (n_given + n_gold) >= 0.8
      ELSE abstained AND len(list_filter(answer_ids, lambda a: a LIKE 'EMP-%')) = 0 END AS fresh
    FROM {scored}) x""")
view("done", "SELECT * FROM {lines} WHERE NOT incomplete")
