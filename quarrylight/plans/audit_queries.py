"""Queries over audits and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators import audit, runs
from quarrylight.plans.bindings import source
from quarrylight.plans.oracle_views import view
from quarrylight.plans.registry import query
from quarrylight.plans.run_bindings import answers, items, lines
from quarrylight.plans.run_queries import plan, quota, r6
from quarrylight.plans.tool_queries import markdown_pages, noted_texts, secret_sql

TERMS = ["enan", "que la"]


def _key(df, *rest):
    return df.select("config", F.col("repeat").cast("bigint"), "item_id", *rest)


@query("audit_identity", """
SELECT file_name, count(DISTINCT (prompt_version, frozen_tree_hash))::BIGINT AS identities FROM {lines}
GROUP BY 1 HAVING count(DISTINCT (prompt_version, frozen_tree_hash)) > 1""")
def audit_identity(spark, sf):
    return audit.mixed_identities(lines(spark, sf))


@query("audit_filename_keys", """
SELECT config, repeat::BIGINT AS repeat, item_id, CASE WHEN file_name = 'notes.txt' THEN 'not a run file name'
  ELSE 'config or repeat differ from the file name' END AS problem
FROM {lines} WHERE file_name <> 'test_' || config || '_r' || repeat || '.jsonl'""")
def audit_filename_keys(spark, sf):
    return _key(audit.misfiled_lines(lines(spark, sf)), "problem")


@query("audit_duplicates", "SELECT file_name, item_id, count(*)::BIGINT AS n FROM {answers} GROUP BY ALL HAVING count(*) > 1")
def audit_duplicates(spark, sf):
    return audit.answered_twice(answers(spark, sf))


@query("audit_unknown_items", "SELECT config, repeat::BIGINT AS repeat, item_id FROM {lines} WHERE category = 'MX'")
def audit_unknown_items(spark, sf):
    # The question set without its mixed category: lines that answer one are unknown to it.
    return _key(audit.unknown_items(lines(spark, sf), items(spark, sf).where("category <> 'MX'")))


@query("audit_rescore", "SELECT config, repeat::BIGINT AS repeat, item_id, correct AS stored, fresh AS correct"
       " FROM {lines} WHERE correct <> fresh")
def audit_rescore(spark, sf):
    return _key(audit.rescored(lines(spark, sf), items(spark, sf)), "stored", "correct")


@query("audit_missing", """
SELECT p.config, r.repeat, count(*)::BIGINT AS planned, count(*) FILTER (l.item_id IS NULL)::BIGINT AS missing
FROM {plan} p, LATERAL (SELECT unnest(range(1, p.repeats + 1)) AS repeat) r JOIN {items} i ON i.category = p.category
LEFT JOIN (SELECT DISTINCT config, repeat, item_id FROM {lines}) l
  ON l.config = p.config AND l.repeat = r.repeat AND l.item_id = i.item_id GROUP BY ALL""")
def audit_missing(spark, sf):
    found = audit.missing_answers(lines(spark, sf), items(spark, sf), plan(spark))
    return found.withColumn("repeat", F.col("repeat").cast("bigint"))


@query("audit_quota_limit", "SELECT day, requests, tokens FROM {quota} WHERE requests > 670")
def audit_quota_limit(spark, sf):
    return audit.over_quota(quota(spark, sf), 670)


view("small_quota", "SELECT day, requests // 2 AS requests FROM {quota}")


@query("audit_calls_vs_requests", """
SELECT date AS day, sum(calls)::BIGINT AS calls, coalesce(any_value(q.requests), 0)::BIGINT AS requests
FROM {lines} JOIN {calls} USING (config, repeat, item_id) LEFT JOIN {small_quota} q ON q.day = date
GROUP BY 1 HAVING sum(calls) > coalesce(any_value(q.requests), 0) * 1.10 + 10""")
def audit_calls_vs_requests(spark, sf):
    small = quota(spark, sf).withColumn("requests", F.floor(F.col("requests") / 2))
    return audit.calls_against_requests(lines(spark, sf), small)



@query("audit_cache_isolation", """
SELECT config, round(r, 6) AS per_answer, round(b, 6) AS baseline, r < b * 0.5 AS suspicious FROM (
  SELECT config, avg(spent) AS r FROM {lines} JOIN {calls} USING (config, repeat, item_id) GROUP BY 1) x,
  (SELECT avg(spent) AS b FROM {lines} JOIN {calls} USING (config, repeat, item_id) WHERE config = 'A0') y
WHERE config <> 'A0'""")
def audit_cache_isolation(spark, sf):
    return audit.cache_isolation(lines(spark, sf)).select(
        "config", *r6("per_answer", "baseline"), "suspicious"
    )


def replayed(spark, sf):
    """Replays of the lines: one in eleven is missing, one in eight answers otherwise."""
    return lines(spark, sf).where("event_id % 11 <> 0").withColumn(
        "answer_ids",
        F.when(F.col("event_id") % 8 == 0, F.array(F.lit("RPT-0000"))).otherwise(F.col("answer_ids")),
    ).withColumn(
        "output_tokens",
        F.when(F.col("event_id") % 16 == 0, F.lit(0)).otherwise(F.col("output_tokens")),
    )


view("replay", """
  SELECT *, CASE WHEN event_id % 11 = 0 THEN 'missed'
    WHEN (event_id % 8 = 0 AND answer_ids <> ['RPT-0000']) OR event_id % 16 = 0 THEN 'differs' ELSE 'identical' END AS status,
    CASE WHEN event_id % 11 = 0 THEN '' ELSE concat_ws(',',
      CASE WHEN event_id % 8 = 0 AND answer_ids <> ['RPT-0000'] THEN 'answer_ids' END,
      CASE WHEN event_id % 16 = 0 THEN 'output_tokens' END) END AS differs
  FROM {lines} WHERE frozen_tree_hash = 'old'""")


def _diff(spark, sf):
    originals = lines(spark, sf).where("frozen_tree_hash = 'old'")
    return audit.replay_diff(originals, replayed(spark, sf))


@query("replay_diff", "SELECT config, repeat::BIGINT AS repeat, item_id, status, differs FROM {replay}")
def replay_diff(spark, sf):
    return _key(_diff(spark, sf), "status", F.array_join("differs", ",").alias("differs"))


@query("replay_rewrite", """
SELECT config, repeat::BIGINT AS repeat, item_id, frozen_tree_hash, NULL AS produced_by, NULL AS equivalence
FROM {lines} WHERE frozen_tree_hash <> 'old'
UNION ALL SELECT config, repeat, item_id, 'frozen', 'old', 'cache_replay_verified' FROM {replay} WHERE status = 'identical'""")
def replay_rewrite(spark, sf):
    kept = audit.replay_rewrite(lines(spark, sf), replayed(spark, sf), "old", "frozen")
    return _key(kept, "frozen_tree_hash", "produced_by", "equivalence")


@query("replay_totals", """
SELECT coalesce(file_name, 'total') AS file_name, count(*)::BIGINT AS checked,
  count(*) FILTER (status = 'identical')::BIGINT AS identical, count(*) FILTER (status = 'differs')::BIGINT AS differs,
  count(*) FILTER (status = 'missed')::BIGINT AS missed FROM {replay} GROUP BY ROLLUP (file_name)""")
def replay_totals(spark, sf):
    return audit.replay_totals(_diff(spark, sf))


@query("published_vs_recomputed", """
SELECT config, stopped_reason, n, 'published' AS side FROM (SELECT config, stopped_reason, count(*)::BIGINT AS n
    FROM {lines} GROUP BY ALL EXCEPT ALL SELECT config, stopped_reason, count(*)::BIGINT FROM {done} GROUP BY ALL) a
UNION ALL SELECT config, stopped_reason, n, 'recomputed' FROM (SELECT config, stopped_reason, count(*)::BIGINT AS n
    FROM {done} GROUP BY ALL EXCEPT ALL SELECT config, stopped_reason, count(*)::BIGINT FROM {lines} GROUP BY ALL) b""")
def published_vs_recomputed(spark, sf):
    published = lines(spark, sf).groupBy("config", "stopped_reason").agg(F.count("*").alias("n"))
    return audit.published_differences(published, runs.stop_reason_counts(lines(spark, sf)))


view("doc_lines", """
  SELECT doc_id, i + 1 AS line, t[i + 1] AS line_text FROM (
    SELECT doc_id, string_split(text, chr(10)) AS t, unnest(range(len(string_split(text, chr(10))))) AS i
    FROM documents) x""")


view("noted_lines", """
  SELECT doc_id, i + 1 AS line, t[i + 1] AS line_text FROM (
    SELECT doc_id, string_split(text, chr(10)) AS t, unnest(range(len(string_split(text, chr(10))))) AS i
    FROM {noted}) x""")


@query("secret_scan", f"SELECT doc_id, line::BIGINT AS line, unnest({secret_sql('line_text')}) AS kind FROM {{noted_lines}}")
def secret_scan(spark, sf):
    found = audit.secret_scan(noted_texts(spark, sf), "doc_id", "text")
    return found.withColumn("line", F.col("line").cast("bigint"))


@query("term_scan", "\nUNION ALL ".join(
    f"SELECT doc_id, line::BIGINT AS line, {n}::BIGINT AS term_number FROM {{doc_lines}} WHERE contains(lower(line_text), '{t}')"
    for n, t in enumerate(TERMS, 1)))
def term_scan(spark, sf):
    found = audit.term_scan(source(spark, sf, "documents"), "doc_id", "text", TERMS)
    return found.select("doc_id", F.col("line").cast("bigint"), F.col("term_number").cast("bigint"))


_HITS = ("list_concat(list_filter([" + ", ".join(
    f"CASE WHEN contains(lower(text), '{t}') THEN 'term {n}' END" for n, t in enumerate(TERMS, 1))
    + "], lambda k: k IS NOT NULL), " + secret_sql("text") + ")")


@query("version_scan", f"""
SELECT path, version, holders, unnest({_HITS}) AS hit FROM (
  SELECT text, arg_min(source, doc_id) AS path, min(doc_id) AS version, count(*)::BIGINT AS holders
  FROM {{noted}} GROUP BY text) x""")
def version_scan(spark, sf):
    versions = noted_texts(spark, sf).selectExpr("source AS path", "doc_id AS version", "text")
    return audit.version_scan(versions, TERMS)


@query("local_link_check", """
SELECT DISTINCT page_id, string_split(link, '#')[1] AS target FROM {page_links} WHERE kind = 'local'
  AND string_split(link, '#')[1] NOT IN (SELECT regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) FROM pages)""")
def local_link_check(spark, sf):
    known = source(spark, sf, "pages").select(
        F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1).alias("target")
    )
    return audit.missing_local_links(markdown_pages(spark, sf), "page_id", "body", known)
