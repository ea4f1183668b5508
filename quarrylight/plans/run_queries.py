"""Queries over run lines: accuracy, cost, error kinds, ablations, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions.scalars import cost_usd
from quarrylight.operators import lineage, runs, scoring
from quarrylight.plans.bindings import catalog, source
from quarrylight.plans.oracle_views import view
from quarrylight.plans.registry import query
from quarrylight.plans.run_bindings import CATEGORIES, items, lines

# Repeats and categories of the run plan.
PLAN = [(c, k, 3 if c == "A0" else 1) for c in ["A0", "A1", "A2", "A4"] for k in CATEGORIES]
PLAN += [("A3", k, 1) for k in ("L2", "L5", "MX")] + [("A5", k, 1) for k in ("L5", "MX")]

view("plan", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{k}', {n})" for c, k, n in PLAN)
     + ") p(config, category, repeats)")


def plan(spark):
    return spark.createDataFrame(PLAN, "config string, category string, repeats bigint")


def r6(*names):
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


@query("run_items", "SELECT item_id, category, subtype, scoring, array_to_string(gold_ids, ',') AS gold_ids,"
       " array_to_string(forbidden_ids, ',') AS forbidden_ids, should_abstain, question FROM {rules}")
def run_items(spark, sf):
    return items(spark, sf).select(
        "item_id", "category", "subtype", "scoring", F.array_join("gold_ids", ",").alias("gold_ids"),
        F.array_join("forbidden_ids", ",").alias("forbidden_ids"), "should_abstain", "question",
    )


@query("scoring_rule", "SELECT category, subtype, len(gold_ids)::BIGINT AS gold_size, scoring,"
       " count(*)::BIGINT AS n FROM {rules} GROUP BY ALL")
def scoring_rule(spark, sf):
    return items(spark, sf).groupBy(
        "category", "subtype", F.size("gold_ids").cast("bigint").alias("gold_size"), "scoring"
    ).agg(F.count("*").alias("n"))


def _score_query(name, rule, columns, sql):
    @query(name, f"SELECT config, repeat::BIGINT AS repeat, item_id, fresh AS correct, {sql}"
           f" FROM {{lines}} WHERE scoring = '{rule}'".replace("{{", "{").replace("}}", "}"))
    def run(spark, sf):
        found = scoring.with_gold(lines(spark, sf), items(spark, sf)).where(F.col("scoring") == rule)
        scores = scoring.score_columns(
            F.col("scoring"), F.col("answer_ids"), F.col("gold_ids"), F.col("forbidden_ids"),
            F.col("abstained"),
        )
        fresh = found.drop("correct").withColumns(scores)
        return fresh.select(
            "config", F.col("repeat").cast("bigint"), "item_id", "correct", *columns()
        )


_score_query("score_contains_all", "contains_all",
             lambda: [F.array_join("forbidden_hit", ",").alias("forbidden_hit")],
             "array_to_string(list_sort(list_distinct(list_intersect(answer_ids, forbidden_ids))), ',')"
             " AS forbidden_hit")
_score_query("score_contains_any", "contains_any", lambda: [F.col("hits").cast("bigint")],
             "tp::BIGINT AS hits")
_score_query("score_set_f1", "set_f1", lambda: r6("precision", "recall", "f1"),
             "round(CASE WHEN n_given > 0 THEN tp::DOUBLE / n_given ELSE 0 END, 6) AS precision,"
             " round(tp::DOUBLE / n_gold, 6) AS recall,"
             " round(2.0::DOUBLE * tp / (n_given + n_gold), 6) AS f1")
_score_query("score_abstain", "abstain",
             lambda: [F.array_join("people_given", ",").alias("people_given")],
             "array_to_string(list_sort(list_distinct(list_filter(answer_ids, lambda a: a LIKE 'EMP-%'))), ',')"
             " AS people_given")


@query("explode_steps", "SELECT config, repeat::BIGINT AS repeat, item_id, pos::BIGINT AS pos, kind,"
       " name, arguments, summary, duration_ms::BIGINT AS duration_ms FROM {steps}")
def explode_steps(spark, sf):
    return runs.explode_steps(lines(spark, sf)).select(
        "config", F.col("repeat").cast("bigint"), "item_id", F.col("pos").cast("bigint"), "kind",
        "name", "arguments", "summary", F.col("duration_ms").cast("bigint"),
    )


@query("complete_lines", "SELECT config, repeat::BIGINT AS repeat, item_id FROM {done}")
def complete_lines(spark, sf):
    return runs.complete_lines(lines(spark, sf)).select(
        "config", F.col("repeat").cast("bigint"), "item_id"
    )


@query("select_items", "SELECT p.config, i.item_id FROM {plan} p JOIN {items} i USING (category)")
def select_items(spark, sf):
    return plan(spark).join(items(spark, sf).select("item_id", "category"), "category").select(
        "config", "item_id"
    )


@query("accuracy", "SELECT config, count(*)::BIGINT AS n, round(avg(correct::INT), 6) AS accuracy"
       " FROM {done} GROUP BY 1")
def accuracy(spark, sf):
    return runs.accuracy(lines(spark, sf), ["config"]).select("config", "n", *r6("accuracy"))


view("by_repeat", "SELECT config, repeat, avg(correct::INT) AS a FROM {done} GROUP BY ALL")
view("qmeans", "SELECT config, category, item_id, avg(correct::INT) AS mean FROM {done} GROUP BY ALL")


@query("accuracy_by_repeat", "SELECT config, count(*)::BIGINT AS repeats, round(avg(a), 6) AS mean,"
       " round(stddev_samp(a), 6) AS std FROM {by_repeat} GROUP BY 1")
def accuracy_by_repeat(spark, sf):
    return runs.accuracy_by_repeat(lines(spark, sf), ["config"]).select(
        "config", "repeats", *r6("mean", "std")
    )


@query("accuracy_by_question", "SELECT config, category, count(*)::BIGINT AS questions,"
       " round(avg(mean), 6) AS accuracy FROM {qmeans} GROUP BY ALL")
def accuracy_by_question(spark, sf):
    return runs.accuracy_by_question(lines(spark, sf), ["config", "category"]).select(
        "config", "category", "questions", *r6("accuracy")
    )


view("grid", """
  SELECT config, category, count(*)::BIGINT AS n, avg(correct::INT) AS accuracy FROM {done} GROUP BY ALL
  UNION ALL SELECT config, 'Overall', count(*), avg(correct::INT) FROM {done} GROUP BY ALL""")


@query("accuracy_grid", "SELECT config, category, n, round(accuracy, 6) AS accuracy FROM {grid}")
def accuracy_grid(spark, sf):
    return runs.accuracy_grid(lines(spark, sf)).select("config", "category", "n", *r6("accuracy"))


view("flips", """
  SELECT config, category, item_id, count(DISTINCT correct) > 1 AS flipped FROM {done} GROUP BY ALL""")


@query("flip_rate", """
SELECT config, category, round(avg(flipped::INT), 6) AS flip_rate FROM {flips} GROUP BY ALL
UNION ALL SELECT config, 'Overall', round(avg(flipped::INT), 6) FROM {flips} GROUP BY ALL""")
def flip_rate(spark, sf):
    return runs.flip_rate(lines(spark, sf)).select("config", "category", *r6("flip_rate"))


view("prf", """
  SELECT config, sum((abstained AND should_abstain)::INT) / nullif(sum(abstained::INT), 0) AS precision,
    sum((abstained AND should_abstain)::INT) / nullif(sum(should_abstain::INT), 0) AS recall,
    sum((abstained AND NOT should_abstain)::INT) / nullif(sum((NOT should_abstain)::INT), 0) AS false_rate
  FROM {done} GROUP BY 1""")


@query("abstention_prf", "SELECT config, round(precision, 6) AS precision, round(recall, 6) AS recall,"
       " round(false_rate, 6) AS false_rate FROM {prf}")
def abstention_prf(spark, sf):
    found = runs.abstention_prf(lines(spark, sf), items(spark, sf), ["config"])
    return found.select("config", *r6("precision", "recall", "false_rate"))


@query("stop_reason_counts", "SELECT config, stopped_reason, count(*)::BIGINT AS n FROM {done} GROUP BY ALL")
def stop_reason_counts(spark, sf):
    return runs.stop_reason_counts(lines(spark, sf))


view("nearest", """
  SELECT config, max(latency_ms) FILTER (rn = round_even(0.5::DOUBLE * (n - 1), 0)) AS p50_ms,
    max(latency_ms) FILTER (rn = round_even(0.95::DOUBLE * (n - 1), 0)) AS p95_ms
  FROM (SELECT config, latency_ms, row_number() OVER (PARTITION BY config ORDER BY latency_ms) - 1 AS rn,
    count(*) OVER (PARTITION BY config) AS n FROM {done}) x GROUP BY 1""")


@query("nearest_rank_percentile", "SELECT config, p50_ms::DOUBLE AS p50_ms, p95_ms::DOUBLE AS p95_ms FROM {nearest}")
def nearest_rank_percentile(spark, sf):
    return runs.nearest_rank_percentiles(lines(spark, sf), ["config"])


view("ops", """
  SELECT d.config, avg(tool_calls) AS tools_per_q, avg(input_tokens + output_tokens) AS tokens_per_q,
    avg((len(stripped_ids) > 0)::INT) AS fabricated_rate,
    (SELECT avg((summary LIKE 'error:%' AND summary <> 'error: BUDGET')::INT) FROM {steps} s
      WHERE s.config = d.config AND s.kind = 'tool' AND NOT s.incomplete) AS tool_error_rate
  FROM {done} d GROUP BY 1""")


@query("operational_metrics", """
SELECT config, round(tools_per_q, 6) AS tools_per_q, round(tool_error_rate, 6) AS tool_error_rate,
  round(tokens_per_q, 6) AS tokens_per_q, round(fabricated_rate, 6) AS fabricated_rate,
  p50_ms::DOUBLE AS p50_ms, p95_ms::DOUBLE AS p95_ms FROM {ops} JOIN {nearest} USING (config)""")
def operational_metrics(spark, sf):
    return runs.operational_metrics(lines(spark, sf)).select(
        "config", *r6("tools_per_q", "tool_error_rate", "tokens_per_q", "fabricated_rate"),
        "p50_ms", "p95_ms",
    )


@query("planned_vs_answered", """
SELECT p.config, planned, coalesce(n, 0)::BIGINT AS answered, greatest(planned - coalesce(n, 0), 0)::BIGINT
  AS missing
FROM (SELECT config, sum(repeats)::BIGINT AS planned FROM {plan} JOIN {items} USING (category) GROUP BY 1) p
LEFT JOIN (SELECT config, count(*) AS n FROM {done} GROUP BY 1) a USING (config)""")
def planned_vs_answered(spark, sf):
    return runs.planned_vs_answered(lines(spark, sf), items(spark, sf), plan(spark))


def quota(spark, sf):
    """One quota row per day of the event table: requests and tokens the provider counted."""
    return source(spark, sf, "events").selectExpr(
        "to_date(cast(ts as timestamp)) AS day", "1 + event_id % 3 AS requests",
        "cast(100 + event_id % 900 as bigint) AS tokens",
    ).groupBy("day").agg(F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"))


view("quota", """
  SELECT ts::DATE AS day, sum(1 + event_id % 3)::BIGINT AS requests,
    sum(100 + event_id % 900)::BIGINT AS tokens FROM events GROUP BY 1""")


@query("quota_totals", "SELECT sum(requests)::BIGINT AS requests, sum(tokens)::BIGINT AS tokens,"
       " count(*)::BIGINT AS days FROM {quota}")
def quota_totals(spark, sf):
    return runs.quota_totals(quota(spark, sf))


view("composition", """
  SELECT coalesce(category, 'Overall') AS category, count(*)::BIGINT AS answers, avg(turns) AS mean_turns,
    avg(chars) AS mean_chars, sum(s1) / sum(chars) AS system_share, sum(s2) / sum(chars) AS tools_share,
    sum(s3) / sum(chars) AS results_share, sum(s4) / sum(chars) AS other_share
  FROM (SELECT config, repeat, item_id, category, count(*) AS turns, sum(system_chars) AS s1,
      sum(tools_chars) AS s2, sum(results_chars) AS s3, sum(other_chars) AS s4,
      sum(system_chars + tools_chars + results_chars + other_chars) AS chars
    FROM {steps} WHERE kind = 'llm' GROUP BY ALL) x GROUP BY ROLLUP (category)""")
_SHARES = ["mean_turns", "mean_chars", "system_share", "tools_share", "results_share", "other_share"]


@query("input_composition", "SELECT category, answers, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in _SHARES) + " FROM {composition}")
def input_composition(spark, sf):
    return runs.input_composition(lines(spark, sf)).select("category", "answers", *r6(*_SHARES))


RATIOS = {"system": 0.25, "tools": 0.3, "results": 0.4, "other": 0.2}


@query("token_estimate", """
SELECT category, round(t, 6) AS tokens, round(mean_chars * system_share * 0.25 / t, 6) AS system_token_share,
  round(mean_chars * tools_share * 0.3 / t, 6) AS tools_token_share,
  round(mean_chars * results_share * 0.4 / t, 6) AS results_token_share,
  round(mean_chars * other_share * 0.2 / t, 6) AS other_token_share,
  (floor(mean_chars / 4) + 1)::BIGINT AS quick_estimate
FROM (SELECT *, mean_chars * (system_share * 0.25::DOUBLE + tools_share * 0.3::DOUBLE
  + results_share * 0.4::DOUBLE + other_share * 0.2::DOUBLE) AS t FROM {composition}) x""")
def token_estimate(spark, sf):
    found = runs.token_estimate(runs.input_composition(lines(spark, sf)), RATIOS)
    names = [f"{s}_token_share" for s in runs.CHAR_SOURCES]
    return found.select("category", *r6("tokens", *names), "quick_estimate")


def payloads(spark, sf):
    """Tool payloads as JSON: the record cards of tables and reports."""
    cat = catalog(spark, sf)
    as_json = F.to_json(F.struct("table_id", "name", "layer", "row_count"), {"ignoreNullFields": "false"})
    tables = cat.tables.select(F.lit("table").alias("tool"), as_json.alias("payload"))
    report = F.struct("report_id", "name", "status", "replaced_by_report_id",
                      (F.col("refresh_status") == "failed").alias("failed"))
    return tables.union(
        cat.reports.select(F.lit("report").alias("tool"),
                           F.to_json(report, {"ignoreNullFields": "false"}).alias("payload"))
    )


view("payload_fields", """
  SELECT 'table' AS tool, [11 + 2 + length(table_id), 7 + 2 + length(name), 8 + 2 + length(layer),
    12 + length(row_count::VARCHAR)] AS sizes, ['table_id', 'name', 'layer', 'row_count'] AS names,
    0 AS nulls, 0 AS falses FROM {tables}
  UNION ALL SELECT 'report', [12 + 2 + length(report_id), 7 + 2 + length(name), 9 + 2 + length(status),
    24 + coalesce(2 + length(replaced_by_report_id), 4), 9 + CASE WHEN refresh_status = 'failed' THEN 4 ELSE 5 END],
    ['report_id', 'name', 'status', 'replaced_by_report_id', 'failed'],
    (replaced_by_report_id IS NULL)::INT, (refresh_status <> 'failed')::INT FROM {reports}""")


@query("field_share", """
SELECT f.tool, f.field, round(f.chars / t.total, 6) AS share FROM (
  SELECT tool, field, sum(size) AS chars FROM (SELECT tool, unnest(names) AS field, unnest(sizes) AS size
    FROM {payload_fields}) x GROUP BY ALL) f
JOIN (SELECT tool, sum(list_sum(sizes) + len(sizes) + 1) AS total FROM {payload_fields} GROUP BY 1) t
  USING (tool)""")
def field_share(spark, sf):
    return runs.field_share(payloads(spark, sf)).select("tool", "field", *r6("share"))


@query("constant_share", """
SELECT tool, count(*)::BIGINT AS calls, round(sum(nulls) * 4 / sum(list_sum(sizes) + len(sizes) + 1), 6) AS null_share,
  round(sum(falses) * 5 / sum(list_sum(sizes) + len(sizes) + 1), 6) AS false_share
FROM {payload_fields} GROUP BY 1""")
def constant_share(spark, sf):
    return runs.constant_share(payloads(spark, sf)).select(
        "tool", "calls", *r6("null_share", "false_share")
    )


view("calls", "SELECT config, repeat, item_id, count(*) FILTER (kind = 'llm') AS calls,"
     " count(*) FILTER (kind = 'llm' AND duration_ms >= 50) AS spent FROM {steps} GROUP BY ALL")


@query("prompt_version_summary", """
SELECT prompt_version, coalesce(category, 'Overall') AS category, count(*)::BIGINT AS answers,
  count(*) FILTER (correct)::BIGINT AS correct,
  round(count(*) FILTER (abstained AND should_abstain) / nullif(count(*) FILTER (abstained), 0), 6) AS abstain_precision,
  round(count(*) FILTER (abstained AND should_abstain) / nullif(count(*) FILTER (should_abstain), 0), 6) AS abstain_recall,
  round(avg(calls), 6) AS calls_per_answer, round(avg(input_tokens), 6) AS input_tokens_per_answer
FROM {lines} JOIN {calls} USING (config, repeat, item_id)
GROUP BY GROUPING SETS ((prompt_version, category), (prompt_version))""")
def prompt_version_summary(spark, sf):
    return runs.prompt_version_summary(lines(spark, sf), items(spark, sf)).select(
        "prompt_version", "category", "answers", "correct",
        *r6("abstain_precision", "abstain_recall", "calls_per_answer", "input_tokens_per_answer"),
    )


@query("mixed_versions", "SELECT file_name, count(DISTINCT prompt_version)::BIGINT AS versions"
       " FROM {lines} GROUP BY 1 HAVING count(DISTINCT prompt_version) > 1")
def mixed_versions(spark, sf):
    return runs.mixed_versions(lines(spark, sf))


def _candidates(spark, sf):
    planned = runs.planned_vs_answered(lines(spark, sf), items(spark, sf), plan(spark))
    limits = planned.select("config", F.when(F.col("config") != "A4", 100 + F.length("config") * 10)
                            .alias("rpd"))
    return runs.candidate_summary(
        lines(spark, sf), planned.select("config", "planned"), limits, plan_answers=665, max_days=15
    )


view("candidates", """
  SELECT config, planned, answered, greatest(planned - answered, 0)::BIGINT AS unanswered,
    (machinery + greatest(planned - answered, 0))::BIGINT AS losses, accuracy, calls_per_answer,
    round_even(calls_per_answer * 665, 0)::BIGINT AS plan_calls,
    CASE WHEN config <> 'A4' THEN ceil(round_even(calls_per_answer * 665, 0) / 120)::BIGINT END AS plan_days,
    coalesce(config <> 'A4' AND ceil(round_even(calls_per_answer * 665, 0) / 120) <= 15, false) AS feasible
  FROM (SELECT p.config, p.planned, count(l.item_id)::BIGINT AS answered,
      count(*) FILTER (l.stopped_reason IN ('parse_failure', 'tool_budget', 'llm_error')) AS machinery,
      avg(l.correct::INT) AS accuracy, avg(c.calls)::DOUBLE AS calls_per_answer
    FROM (SELECT config, sum(repeats)::BIGINT AS planned FROM {plan} JOIN {items} USING (category) GROUP BY 1) p
    LEFT JOIN {lines} l ON l.config = p.config
    LEFT JOIN {calls} c ON c.config = l.config AND c.repeat = l.repeat AND c.item_id = l.item_id
    GROUP BY ALL) x""")


@query("candidate_summary", """
SELECT config, planned, answered, unanswered, losses, round(accuracy, 6) AS accuracy,
  round(calls_per_answer, 6) AS calls_per_answer, plan_calls, plan_days, feasible FROM {candidates}""")
def candidate_summary(spark, sf):
    return _candidates(spark, sf).select(
        "config", "planned", "answered", "unanswered", "losses", *r6("accuracy", "calls_per_answer"),
        "plan_calls", "plan_days", "feasible",
    )


@query("choose_candidate", """
SELECT CASE WHEN count(*) FILTER (unanswered > 0) = 0 THEN arg_min(config, (losses, -accuracy, config)) END AS chosen,
  count(*) FILTER (unanswered > 0)::BIGINT AS waiting, count(*)::BIGINT AS feasible
FROM {candidates} WHERE feasible""")
def choose_candidate(spark, sf):
    return runs.choose_candidate(_candidates(spark, sf))


@query("requests_per_config", """
SELECT config, count(*)::BIGINT AS answers, sum(spent)::BIGINT AS requests,
  round(sum(spent) / count(*), 6) AS per_answer, count(*) FILTER (spent = 0)::BIGINT AS free_answers,
  count(*) FILTER (latency_ms < 500)::BIGINT AS fast_answers,
  round(median(latency_ms), 6) AS median_latency_ms
FROM {lines} JOIN {calls} USING (config, repeat, item_id) GROUP BY 1""")
def requests_per_config(spark, sf):
    return runs.requests_per_config(lines(spark, sf)).select(
        "config", "answers", "requests", *r6("per_answer"), "free_answers", "fast_answers",
        *r6("median_latency_ms"),
    )


@query("latency_gap", """
SELECT max(duration_ms) FILTER (duration_ms < 50)::BIGINT AS slowest_cached_ms,
  min(duration_ms) FILTER (duration_ms >= 50)::BIGINT AS fastest_live_ms FROM {steps} WHERE kind = 'llm'""")
def latency_gap(spark, sf):
    found = runs.latency_gap(lines(spark, sf))
    return found.select(*[F.col(c).cast("bigint").alias(c) for c in found.columns])


@query("shared_traces", """
WITH t AS (SELECT item_id, config, coalesce(tr, '') AS tr FROM {lines} LEFT JOIN (
  SELECT config, repeat, item_id, string_agg(name || ' ' || arguments, chr(10) ORDER BY pos) AS tr
  FROM {steps} WHERE kind = 'tool' GROUP BY ALL) s USING (config, repeat, item_id)),
m AS (SELECT item_id FROM t GROUP BY 1 HAVING count(DISTINCT config) > 1)
SELECT (SELECT count(*) FROM m)::BIGINT AS comparable, count(DISTINCT a.item_id)::BIGINT AS shared
FROM t a JOIN t b ON a.item_id = b.item_id AND a.tr = b.tr AND a.config < b.config""".replace("WITH t", "WITH t", 1))
def shared_traces(spark, sf):
    return runs.shared_traces(lines(spark, sf))


@query("missing_id_types", """
SELECT config, split_part(id, '-', 1) AS id_type, count(*)::BIGINT AS missing FROM (
  SELECT config, unnest(list_filter(gold_ids, lambda g: NOT list_contains(answer_ids, g))) AS id
  FROM {done} WHERE NOT correct AND NOT abstained) x GROUP BY ALL""")
def missing_id_types(spark, sf):
    return runs.missing_id_types(lines(spark, sf), items(spark, sf), ["config"])


_U = "('0x' || substr(md5('0:' || (b // 4) || ':' || item_id), 1 + 8 * (b % 4), 8))::BIGINT"


def _poisson_sql() -> str:
    below, term, parts = 0.0, 0.36787944117144233, []
    for k in range(1, 14):
        below += term
        parts.append(f"(u >= {int(below * 2**32)})::INT")
        term = term / k
    return " + ".join(parts)


view("ci", f"""
  SELECT config, list_sort(list(value))[26] AS low, list_sort(list(value))[975] AS high FROM (
    SELECT config, b, sum(w * mean) / sum(w) AS value FROM (
      SELECT config, b, mean, {_poisson_sql()} AS w FROM (
        SELECT config, mean, b, {_U} AS u FROM {{qmeans}}, (SELECT unnest(range(0, 1000)) AS b) r) y) z
    GROUP BY ALL) x GROUP BY 1""".replace("{{", "{").replace("}}", "}"))


@query("bootstrap_ci", "SELECT config, round(low, 6) AS low, round(high, 6) AS high FROM {ci}")
def bootstrap_ci(spark, sf):
    means = runs.question_means(lines(spark, sf), ["config"])
    return runs.bootstrap_ci(means, ["config"]).select("config", *r6("low", "high"))


view("fullspread", "SELECT avg(a) AS mean, stddev_samp(a) AS std FROM {by_repeat} WHERE config = 'A0'")
view("marks", """
  SELECT config, accuracy, accuracy - mean AS difference,
    CASE WHEN std IS NULL THEN '' WHEN abs(accuracy - mean) >= 0.03 AND abs(accuracy - mean) > 2 * std
      THEN CASE WHEN accuracy > mean THEN 'up' ELSE 'down' END
      WHEN abs(accuracy - mean) <= std THEN 'equal' ELSE '' END AS mark, std
  FROM {grid}, {fullspread} WHERE category = 'Overall' AND config <> 'A0'""")


@query("effect_marks", "SELECT config, round(accuracy, 6) AS accuracy, round(difference, 6) + 0.0::DOUBLE AS difference,"
       " mark FROM {marks}")
def effect_marks(spark, sf):
    return runs.effect_marks(lines(spark, sf)).select(
        "config", *r6("accuracy", "difference"), "mark"
    )


view("cell_ci", f"""
  SELECT config, category, list_sort(list(value))[26] AS low, list_sort(list(value))[975] AS high FROM (
    SELECT config, category, b, sum(w * mean) / nullif(sum(w), 0) AS value FROM (
      SELECT config, category, b, mean, {_poisson_sql()} AS w FROM (
        SELECT config, category, mean, b, {_U} AS u FROM {{qmeans}},
          (SELECT unnest(range(0, 1000)) AS b) r) y) z
    GROUP BY ALL HAVING sum(w) > 0) x GROUP BY ALL""".replace("{{", "{").replace("}}", "}"))


@query("category_marks", """
SELECT c.config, c.category, c.n, round(c.accuracy, 6) AS accuracy,
  CASE WHEN i.low > f.high THEN 'up' WHEN i.high < f.low THEN 'down'
    WHEN abs(c.accuracy - s.mean) <= s.std THEN 'equal' ELSE '' END AS mark
FROM {grid} c JOIN {cell_ci} i USING (config, category)
JOIN {cell_ci} f ON f.config = 'A0' AND f.category = c.category
JOIN (SELECT category, avg(a) AS mean, stddev_samp(a) AS std FROM (SELECT category, repeat,
  avg(correct::INT) AS a FROM {done} WHERE config = 'A0' GROUP BY ALL) x GROUP BY 1) s
  ON s.category = c.category
WHERE c.config <> 'A0'""")
def category_marks(spark, sf):
    return runs.category_marks(lines(spark, sf)).select(
        "config", "category", "n", *r6("accuracy"), "mark"
    )


_TABLE = ["L1", "L2", "L3", "L4", "L5", "L6", "MX", "Overall"]
_REST = ["delta", "precision", "recall", "false_rate", "fabricated_rate", "tools_per_q", "tokens_per_q"]


@query("ablation_table", "SELECT g.config, " + ", ".join(
    f"round(g.{c}, 6) AS {c}" for c in _TABLE) + """, round(g.Overall - f.mean, 6) + 0.0::DOUBLE AS delta,
  round(precision, 6) AS precision, round(recall, 6) AS recall, round(false_rate, 6) AS false_rate,
  round(fabricated_rate, 6) AS fabricated_rate, round(tools_per_q, 6) AS tools_per_q,
  round(tokens_per_q, 6) AS tokens_per_q, p95_ms::DOUBLE AS p95_ms
FROM (SELECT config, """ + ", ".join(
    f"max(accuracy) FILTER (category = '{c}') AS {c}" for c in _TABLE) + """ FROM {grid} GROUP BY 1) g
JOIN {prf} p USING (config) JOIN {ops} o USING (config) JOIN {nearest} n USING (config), {fullspread} f""")
def ablation_table(spark, sf):
    return runs.ablation_table(lines(spark, sf), items(spark, sf)).select(
        "config", *r6(*_TABLE, *_REST), "p95_ms"
    )


@query("ablation_reading", """
SELECT config, round(accuracy, 6) AS accuracy, round(difference, 6) + 0.0::DOUBLE AS difference, mark,
  w.category AS noisiest_category, round(w.flip_rate, 6) AS noisiest_flip_rate,
  coalesce(std = 0, false) AS zero_noise, difference > 0 AS beats_full
FROM {marks}, (SELECT category, avg(flipped::INT) AS flip_rate FROM {flips} WHERE config = 'A0'
  GROUP BY 1 ORDER BY flip_rate DESC, category DESC LIMIT 1) w""")
def ablation_reading(spark, sf):
    return runs.ablation_reading(lines(spark, sf)).select(
        "config", *r6("accuracy", "difference"), "mark", "noisiest_category",
        *r6("noisiest_flip_rate"), "zero_noise", "beats_full",
    )


def shown(spark, sf):
    """What the stored lineage calls return when run again: every distinct call runs once."""
    cat = catalog(spark, sf)

    def build():
        calls = runs.explode_steps(lines(spark, sf)).where(
            "kind = 'tool' AND name = 'trace_lineage'"
        ).select(
            *runs.KEY,
            F.get_json_object("arguments", "$.node_id").alias("seed"),
            F.get_json_object("arguments", "$.direction").alias("direction"),
            F.get_json_object("arguments", "$.depth").cast("int").alias("depth"),
        )
        found = []
        for direction in ("upstream", "downstream"):
            asked = calls.where(F.col("direction") == direction).select("seed", "depth").distinct()
            traced = lineage.top_nodes(lineage.bfs(cat, asked, direction))
            found.append(
                traced.select("seed", "depth", "node").withColumn("direction", F.lit(direction))
            )
        known = lineage.lineage_nodes(cat).select(F.col("id").alias("seed"))
        returned = found[0].unionByName(found[1])
        nodes = calls.join(returned, ["seed", "direction", "depth"]).select(
            *runs.KEY, F.col("node").alias("record_id")
        )
        roots = calls.join(known, "seed", "left_semi").select(
            *runs.KEY, F.col("seed").alias("record_id")
        )
        return nodes.union(roots).distinct()

    return cat.once("shown", build)


view("call_args", """
  SELECT config, repeat, item_id, node_id AS seed, depth,
    CASE WHEN event_id % 2 = 0 THEN 'upstream' ELSE 'downstream' END AS direction
  FROM {steps} WHERE kind = 'tool' AND name = 'trace_lineage'""")
for _direction, _begin, _end in (("downstream", "src", "dst"), ("upstream", "dst", "src")):
    view(f"called_{_direction}", f"""
      SELECT seed, depth, node, row_number() OVER (PARTITION BY seed, depth ORDER BY distance, node) AS rn
      FROM (SELECT seed, depth, node, min(distance) AS distance FROM (
        WITH RECURSIVE b(seed, depth, node, distance) AS (
          SELECT DISTINCT s.seed, s.depth, e.{_end}, 1 FROM {{call_args}} s
            JOIN {{edges}} e ON e.{_begin} = s.seed WHERE s.direction = '{_direction}'
          UNION SELECT b.seed, b.depth, e.{_end}, b.distance + 1 FROM b
            JOIN {{edges}} e ON e.{_begin} = b.node WHERE b.distance < b.depth)
        SELECT * FROM b) x GROUP BY ALL) y""".replace("{{", "{").replace("}}", "}"))
view("shown", """
  SELECT DISTINCT config, repeat, item_id, node AS record_id FROM (
    SELECT c.config, c.repeat, c.item_id, d.node FROM {call_args} c JOIN {called_downstream} d
      ON d.seed = c.seed AND d.depth = c.depth AND c.direction = 'downstream' AND d.rn <= 100
    UNION ALL SELECT c.config, c.repeat, c.item_id, d.node FROM {call_args} c JOIN {called_upstream} d
      ON d.seed = c.seed AND d.depth = c.depth AND c.direction = 'upstream' AND d.rn <= 100
    UNION ALL SELECT config, repeat, item_id, seed FROM {call_args}
      WHERE seed IN (SELECT table_id FROM {tables})) x""")


@query("shown_ids", "SELECT config, repeat::BIGINT AS repeat, item_id, record_id FROM {shown}")
def shown_ids(spark, sf):
    return shown(spark, sf).withColumn("repeat", F.col("repeat").cast("bigint"))


@query("replay_coverage", """
SELECT count(*) FILTER (covered)::BIGINT AS covered, count(*)::BIGINT AS answers FROM (
  SELECT (config, repeat, item_id) IN (SELECT (config, repeat, item_id) FROM {shown}) AS covered
  FROM {done}) x""")
def replay_coverage(spark, sf):
    return runs.replay_coverage(lines(spark, sf), shown(spark, sf))


def judged(spark, sf):
    """Judged lines on the evidence of the replayed calls, built once per session."""
    cat = catalog(spark, sf)
    return cat.once(
        "judged", lambda: runs.judged_lines(lines(spark, sf), items(spark, sf), shown(spark, sf))
    )


view("judged", """
  SELECT *, CASE WHEN correct THEN NULL WHEN should_abstain THEN 'missing abstain'
      WHEN abstained THEN 'needless abstain' WHEN right_call = false THEN 'wrong tool or arguments'
      WHEN gold_unseen THEN 'retrieval ceiling' WHEN over_inclusive THEN 'over-inclusive'
      ELSE 'right tool, wrong reading' END AS error_kind
  FROM (SELECT d.*, CASE
      WHEN gold_type IN ('upstream_tables', 'downstream_reports') THEN coalesce(t.traced, false)
        AND event_id % 2 = CASE WHEN gold_type = 'upstream_tables' THEN 0 ELSE 1 END
      WHEN gold_type = 'impact_notify' THEN coalesce(t.impact, false) END AS right_call,
      len(gold_ids) > 0 AND NOT CASE WHEN s.ids IS NOT NULL THEN list_has_any(gold_ids, s.ids)
        ELSE len(list_filter(gold_ids, lambda g: contains(coalesce(t.summaries, ''), g))) > 0 END AS gold_unseen,
      len(gold_ids) > 0 AND tp = n_gold AND n_given > tp AS over_inclusive
    FROM {done} d
    LEFT JOIN (SELECT config, repeat, item_id, bool_or(name = 'trace_lineage') AS traced,
        bool_or(name = 'impact_analysis') AS impact, string_agg(summary, ' ' ORDER BY pos) AS summaries
      FROM {steps} WHERE kind = 'tool' GROUP BY ALL) t USING (config, repeat, item_id)
    LEFT JOIN (SELECT config, repeat, item_id, list(record_id) AS ids FROM {shown} GROUP BY ALL) s
      USING (config, repeat, item_id)) x""")


@query("correct_call", "SELECT config, repeat::BIGINT AS repeat, item_id, right_call FROM {judged}")
def correct_call(spark, sf):
    return judged(spark, sf).select(
        "config", F.col("repeat").cast("bigint"), "item_id", "right_call"
    )


@query("gold_unseen", "SELECT config, repeat::BIGINT AS repeat, item_id, gold_unseen FROM {judged}")
def gold_unseen(spark, sf):
    return judged(spark, sf).select(
        "config", F.col("repeat").cast("bigint"), "item_id", "gold_unseen"
    )


@query("classify_error", "SELECT config, repeat::BIGINT AS repeat, item_id, error_kind FROM {judged}"
       " WHERE NOT correct")
def classify_error(spark, sf):
    return judged(spark, sf).where("NOT correct").select(
        "config", F.col("repeat").cast("bigint"), "item_id", "error_kind"
    )


_KINDS = ", ".join(
    f"count(*) FILTER (error_kind = '{k}')::BIGINT AS "
    + k.replace(" ", "_").replace(",", "").replace("-", "_") for k in runs.ERROR_KINDS
)


@query("error_kind_counts", f"SELECT config, category, count(*)::BIGINT AS wrong, {_KINDS},"
       " count(*) FILTER (gold_unseen)::BIGINT AS gold_never_retrieved FROM {judged}"
       " WHERE NOT correct GROUP BY ALL")
def error_kind_counts(spark, sf):
    return runs.error_kind_counts(judged(spark, sf), ["config", "category"])


view("failures", """
  SELECT *, row_number() OVER (PARTITION BY config, category ORDER BY (item_id <> first_item)::INT,
    item_id, repeat) AS place
  FROM (SELECT *, min(item_id) OVER (PARTITION BY config, category, error_kind) AS first_item
    FROM (SELECT *, row_number() OVER (PARTITION BY config, category, item_id ORDER BY repeat) AS rn
      FROM {judged} WHERE NOT correct) x WHERE rn = 1) y""")


@query("first_failure_per_kind", "SELECT config, category, item_id, error_kind FROM {failures} WHERE place <= 3")
def first_failure_per_kind(spark, sf):
    return runs.representative_failures(judged(spark, sf), ["config", "category"]).select(
        "config", "category", "item_id", "error_kind"
    )


@query("representative_failures", """
SELECT config, category, item_id, repeat::BIGINT AS repeat, error_kind,
  array_to_string(list_sort(list_filter(gold_ids, lambda g: NOT list_contains(answer_ids, g))), ',') AS missing_ids,
  array_to_string(list_sort(list_filter(forbidden_ids, lambda g: list_contains(answer_ids, g))), ',') AS forbidden_given,
  array_to_string(list_sort(list_distinct(list_filter(answer_ids, lambda g: NOT list_contains(gold_ids, g)
    AND NOT list_contains(forbidden_ids, g)))), ',') AS extra_ids, stopped_reason, tool_calls::BIGINT AS tool_calls
FROM {failures} WHERE place <= 3""")
def representative_failures(spark, sf):
    found = runs.representative_failures(judged(spark, sf), ["config", "category"])
    lists = ["missing_ids", "forbidden_given", "extra_ids"]
    return found.withColumns({c: F.array_join(c, ",") for c in lists}).withColumns(
        {c: F.col(c).cast("bigint") for c in ("repeat", "tool_calls")}
    )


_DIAG = ["over_inclusive_rate", "tool_args_correct", "accuracy_when_args_correct", "in_cluster_precision"]


@query("diagnostics", """
SELECT config, category, round(avg(over_inclusive::INT), 6) AS over_inclusive_rate,
  count(*) FILTER (NOT correct)::BIGINT AS wrong_answers,
  count(*) FILTER (NOT correct AND gold_unseen)::BIGINT AS wrong_with_gold_unseen,
  round(avg(right_call::INT), 6) AS tool_args_correct,
  round(avg(correct::INT) FILTER (right_call), 6) AS accuracy_when_args_correct,
  round(avg(len(list_filter(answer_ids, lambda a: list_contains(gold_ids, a))) / len(answer_ids))
    FILTER (category = 'L4' AND len(answer_ids) > 0), 6) AS in_cluster_precision
FROM {judged} WHERE category <> 'L6' GROUP BY ALL""")
def diagnostics(spark, sf):
    return runs.diagnostics(judged(spark, sf), ["config"]).select(
        "config", "category", "wrong_answers", "wrong_with_gold_unseen", *r6(*_DIAG)
    )


@query("determinism_check", """
SELECT config, count(*)::BIGINT AS questions, count(*) FILTER (c = 1)::BIGINT AS agreeing,
  count(*) FILTER (a = 1)::BIGINT AS identical_texts
FROM (SELECT config, item_id, count(DISTINCT correct) AS c, count(DISTINCT answer) AS a FROM {done}
  GROUP BY ALL) x GROUP BY 1""")
def determinism_check(spark, sf):
    return runs.determinism_check(lines(spark, sf))


@query("retrieval_ceiling", "SELECT config, count(*)::BIGINT AS wrong, count(*) FILTER (gold_unseen)::BIGINT"
       " AS unseen, round(avg(gold_unseen::INT), 6) AS share FROM {judged} WHERE NOT correct GROUP BY 1")
def retrieval_ceiling(spark, sf):
    return runs.retrieval_ceiling(judged(spark, sf)).select("config", "wrong", "unseen", *r6("share"))


_COUNTS = ["answers", "wrong", *[f"kind_{n}" for n in range(6)]]
_PER = ", ".join(
    ["count(*) / count(DISTINCT repeat) AS answers", "count(*) FILTER (NOT correct) / count(DISTINCT repeat) AS wrong"]
    + [f"count(*) FILTER (error_kind = '{k}') / count(DISTINCT repeat) AS kind_{n}"
       for n, k in enumerate(runs.ERROR_KINDS)]
)


@query("ablation_shift", f"""
SELECT m.config, {", ".join(f"round(m.{c}, 6) AS {c}, round(f.{c}, 6) AS full_{c}" for c in _COUNTS)}
FROM (SELECT config, {_PER} FROM {{judged}} WHERE config <> 'A0' GROUP BY 1) m
JOIN (SELECT o.config, {_PER.replace("count(DISTINCT repeat)", "(SELECT count(DISTINCT repeat) FROM {{judged}} WHERE config = 'A0')")}
  FROM {{judged}} j JOIN (SELECT DISTINCT config, category FROM {{judged}} WHERE config <> 'A0') o
    ON o.category = j.category WHERE j.config = 'A0' GROUP BY 1) f USING (config)""".replace("{{", "{").replace("}}", "}"))
def ablation_shift(spark, sf):
    found = runs.ablation_shift(judged(spark, sf))
    return found.select("config", *r6(*[c for n in _COUNTS for c in (n, f"full_{n}")]))


@query("component_gap", """
WITH m AS (SELECT config, split_part(id, '-', 1) AS id_type, count(*) AS n FROM (
    SELECT config, unnest(list_filter(gold_ids, lambda g: NOT list_contains(answer_ids, g))) AS id
    FROM {done} WHERE NOT correct AND NOT abstained) x GROUP BY ALL),
  r AS (SELECT config, count(DISTINCT repeat) AS reps FROM {done} GROUP BY 1),
  g AS (SELECT r.config, t.id_type, coalesce(a.n, 0) / r.reps
      - coalesce(f.n, 0) / (SELECT reps FROM r WHERE config = 'A0') AS gap
    FROM r CROSS JOIN (SELECT DISTINCT id_type FROM m) t
    LEFT JOIN m a ON a.config = r.config AND a.id_type = t.id_type
    LEFT JOIN m f ON f.config = 'A0' AND f.id_type = t.id_type WHERE r.config <> 'A0')
SELECT config, CASE WHEN max(gap) > 0 THEN arg_max(id_type, (gap, id_type)) END AS id_type,
  CASE WHEN max(gap) > 0 THEN round(max(gap), 6) END AS gap FROM g GROUP BY 1""")
def component_gap(spark, sf):
    return runs.component_gap(lines(spark, sf), items(spark, sf)).select(
        "config", "id_type", *r6("gap")
    )


@query("cost_usd", "SELECT config, round(sum((input_tokens * 0.15::DOUBLE + output_tokens * 0.6::DOUBLE)"
       " / 1000000.0::DOUBLE), 6) AS cost_usd FROM {lines} GROUP BY 1")
def cost(spark, sf):
    spent = cost_usd(F.col("input_tokens"), F.col("output_tokens"), 0.15, 0.6)
    return lines(spark, sf).groupBy("config").agg(F.round(F.sum(spent), 6).alias("cost_usd"))


@query("ground_answers", """
SELECT config, repeat::BIGINT AS repeat, item_id,
  CASE WHEN event_id % 6 = 0 THEN 'see ' || CASE WHEN list_contains(ids, node_id) THEN node_id ELSE '[unverified]' END
      || ' and [unverified]'
    ELSE 'see ' || CASE WHEN list_contains(ids, node_id) THEN node_id ELSE '[unverified]' END END
    || CASE WHEN emptied THEN ' (I could not verify the records behind this answer in the tool results, so I am not giving one.)' ELSE '' END AS answer,
  array_to_string(kept, ',') AS answer_ids, abstained OR emptied AS abstained
FROM (SELECT *, len(answer_ids) > 0 AND len(kept) = 0 AND NOT abstained AS emptied FROM (
  SELECT l.*, coalesce(s.ids, []::VARCHAR[]) AS ids,
    list_filter(l.answer_ids, lambda a: list_contains(coalesce(s.ids, []::VARCHAR[]), a)) AS kept
  FROM {lines} l LEFT JOIN (SELECT config, repeat, item_id, list(record_id) AS ids FROM {shown} GROUP BY ALL) s
    USING (config, repeat, item_id)) x) y""")
def ground_answers(spark, sf):
    found = scoring.ground_answers(lines(spark, sf).drop("stripped_ids"), shown(spark, sf), runs.KEY)
    return found.select(
        "config", F.col("repeat").cast("bigint"), "item_id", "answer",
        F.array_join("answer_ids", ",").alias("answer_ids"), "abstained",
    )
