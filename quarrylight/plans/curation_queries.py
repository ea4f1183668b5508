"""Queries over evaluation-set curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators import curation
from quarrylight.plans.bindings import catalog, source
from quarrylight.plans.oracle_views import view
from quarrylight.plans.quality_queries import (
    chains,
    deprecated_pairs,
    designed_pairs,
    rows_sql,
    topics,
    traits,
)
from quarrylight.plans.registry import query
from quarrylight.plans.run_bindings import CATEGORIES, items
from quarrylight.plans.search_queries import asset_corpus
from quarrylight.plans.search_views import FUNCTIONS, norm_sql, word_set_sql

SEED = "42"


def h(*keys: str) -> str:
    return "md5('" + SEED + ":' || " + " || ':' || ".join(keys) + ")"


view("noise", """
  SELECT DISTINCT unnest([a, b]) AS report_id FROM (SELECT a, b FROM {designed}
    UNION ALL SELECT report_id, replaced_by_report_id FROM {reports} WHERE replaced_by_report_id IS NOT NULL) x""")


def noise(spark, sf):
    return curation.noise_members(designed_pairs(spark, sf), deprecated_pairs(spark, sf))


@query("noise_members", "SELECT report_id FROM {noise}")
def noise_members(spark, sf):
    return noise(spark, sf)


view("alone", """
  SELECT report_id, subject, qualifier FROM (SELECT *, count(*) OVER (PARTITION BY subject, qualifier) AS n
    FROM {traits}) x WHERE n = 1""")


@query("unique_combos", "SELECT report_id, subject, qualifier FROM {alone}")
def unique_combos(spark, sf):
    return curation.unique_combos(traits(spark, sf))


view("acronyms", """
  SELECT alias, min(metric_id) AS metric_id FROM (SELECT metric_id, unnest(string_split(aliases, '|')) AS alias
    FROM {metrics}) x WHERE regexp_full_match(alias, '[A-Z0-9%&]{2,}') AND rtrim(alias, '%') NOT IN
    (SELECT unnest(string_split(tags, '|')) FROM {reports}) GROUP BY 1 HAVING count(DISTINCT metric_id) = 1""")


@query("unambiguous_aliases", "SELECT alias, metric_id FROM {acronyms}")
def unambiguous_aliases(spark, sf):
    return curation.unambiguous_aliases(catalog(spark, sf))


# Templates and phrases of the paraphrase questions.
TEMPLATES = ["Where do I find {topic} split by {dimension}?", "Who keeps {topic} per {dimension}?"]


def topic_phrases(spark, sf):
    """Two phrases per subject: one neutral, one that borrows the words of report names."""
    subjects = traits(spark, sf).select("subject").distinct()
    return subjects.select(
        "subject",
        F.explode(F.array(F.concat(F.lit("numbers of "), F.col("subject")), F.lit("the low building view"))).alias("phrase"),
    )


def dimension_phrases(spark, sf):
    return traits(spark, sf).select("qualifier").distinct().select(
        "qualifier", F.concat(F.lit("rank "), F.col("qualifier")).alias("phrase")
    )


def eligible(spark, sf):
    """Active reports outside the designed pairs that are alone with subject and qualifier."""
    active = curation.active_reports(catalog(spark, sf), noise(spark, sf)).select("report_id")
    return curation.unique_combos(traits(spark, sf)).join(active, "report_id")


_FRAME = "('where', 'do', 'i', 'find', 'split', 'by', 'keeps', 'per')"
_QWORDS = f"list_filter({word_set_sql('query')}, lambda w: w NOT IN {_FRAME} AND w NOT IN {FUNCTIONS})"
view("para_pool", f"""
  SELECT * FROM (SELECT a.report_id, a.subject, replace(replace(t, '{{topic}}', p), '{{dimension}}', 'rank ' || a.qualifier) AS query,
      r.name, r.description || ' ' || r.tags AS body
    FROM {{alone}} a JOIN {{reports}} r USING (report_id),
      LATERAL (SELECT unnest(['numbers of ' || a.subject, 'the low building view']) AS p) x,
      (SELECT unnest(['{TEMPLATES[0]}', '{TEMPLATES[1]}']) AS t) y
    WHERE r.status = 'active' AND a.report_id NOT IN (SELECT report_id FROM {{noise}})) z
  WHERE coalesce(len(list_intersect({word_set_sql('name')}, {word_set_sql('query')}))::DOUBLE
      / nullif(len({word_set_sql('name')}), 0), 0) <= 0.3
    AND coalesce(len(list_filter({_QWORDS}, lambda w: list_contains({word_set_sql('body')}, w)))::DOUBLE
      / nullif(len({_QWORDS}), 0), 0) <= 0.2""".replace("{{alone}}", "{alone}").replace("{{reports}}", "{reports}").replace("{{noise}}", "{noise}"))


@query("paraphrase_candidates", f"""
SELECT subject, report_id, query FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY {h('query')}, query) AS rn
  FROM {{para_pool}}) x WHERE rn = 1""".replace("{{", "{").replace("}}", "}"))
def paraphrase_candidates(spark, sf):
    return curation.paraphrase_candidates(
        catalog(spark, sf), eligible(spark, sf), topic_phrases(spark, sf), dimension_phrases(spark, sf),
        TEMPLATES, SEED,
    )


@query("disambiguation_items", """
SELECT CASE WHEN x.status = 'active' THEN d.a ELSE d.b END AS target_id,
  CASE WHEN x.status = 'active' THEN d.b ELSE d.a END AS forbidden_id
FROM {designed} d JOIN {reports} x ON x.report_id = d.a JOIN {reports} y ON y.report_id = d.b
WHERE x.status = 'active' OR y.status = 'active'""")
def disambiguation_items(spark, sf):
    return curation.disambiguation_items(catalog(spark, sf), designed_pairs(spark, sf))


PREFIXES = ["dim", "global"]
FORMATS = ["", " 7", " report"]


def fragments(spark, sf):
    return source(spark, sf, "part").select(F.col("p_name").alias("fragment")).distinct()


view("negatives", f"""
  SELECT name FROM (SELECT DISTINCT p || ' ' || p_name || f AS name FROM part,
    (SELECT unnest(['dim', 'global']) AS p) a, (SELECT unnest(['', ' 7', ' report']) AS f) b) x
  WHERE NOT EXISTS (SELECT 1 FROM {{asset_docs}} d WHERE len(list_filter(d.exact_names, lambda n:
    contains({norm_sql('x.name')}, {norm_sql('n')}))) > 0)""".replace("{{", "{").replace("}}", "}"))


@query("negative_names", "SELECT name FROM {negatives}")
def negative_names(spark, sf):
    return curation.negative_names(fragments(spark, sf), PREFIXES, FORMATS, asset_corpus(spark, sf).names)


@query("exact_items", f"""
SELECT flavour, target_id, asked, place::BIGINT AS place FROM (
  SELECT *, row_number() OVER (PARTITION BY flavour ORDER BY {h('target_id')}, target_id) AS place FROM (
    SELECT 'table name' AS flavour, table_id AS target_id, name AS asked FROM {{tables}}
    UNION ALL SELECT 'metric acronym', metric_id, alias FROM {{acronyms}}
    UNION ALL SELECT 'report ID', report_id, report_id FROM {{reports}} WHERE report_id NOT IN (SELECT report_id FROM {{noise}})) x) y
WHERE place <= 5""".replace("{{", "{").replace("}}", "}"))
def exact_items(spark, sf):
    found = curation.exact_items(catalog(spark, sf), noise(spark, sf), 5, SEED)
    return found.withColumn("place", F.col("place").cast("bigint"))


@query("chain_targets", f"""
SELECT 'C' || len(c.chain) AS code, CASE WHEN substr({h('c.head')}, 1, 1) < 'a' THEN 'test' ELSE 'dev' END AS split,
  rn::BIGINT AS round, c.head AS head_id, r.report_id
FROM {{chains}} c JOIN (SELECT owner_id, report_id, row_number() OVER (PARTITION BY owner_id
    ORDER BY {h('report_id')}, report_id) AS rn FROM {{reports}} WHERE status = 'active') r ON r.owner_id = c.head
WHERE rn <= 4""".replace("{{", "{").replace("}}", "}"))
def chain_targets(spark, sf):
    found = curation.chain_targets(catalog(spark, sf), chains(spark, sf), 4, SEED)
    return found.withColumn("round", F.col("round").cast("bigint"))


def sizes(spark, sf):
    cat = catalog(spark, sf)
    bare = cat.metrics.where("formula IS NULL").select("metric_id")
    return cat.once("lineage_sizes", lambda: curation.lineage_sizes(cat, bare))


view("dist_up", """
  SELECT seed, node, min(d) AS d FROM (
    WITH RECURSIVE u(seed, node, d) AS (
      SELECT metric_id, table_id, 1 FROM {medges} UNION ALL SELECT report_id, table_id, 1 FROM {redges}
      UNION SELECT u.seed, e.parent_table_id, u.d + 1 FROM u JOIN {tedges} e ON e.child_table_id = u.node WHERE u.d < 6)
    SELECT * FROM u) x GROUP BY ALL""")
view("dist_down", """
  SELECT seed, node, min(d) AS d FROM (
    WITH RECURSIVE u(seed, node, d) AS (SELECT table_id, table_id, 0 FROM {tables} WHERE layer = 'staging'
      UNION SELECT u.seed, e.child_table_id, u.d + 1 FROM u JOIN {tedges} e ON e.parent_table_id = u.node WHERE u.d < 5)
    SELECT * FROM u) x GROUP BY ALL""")
view("lsizes", """
  SELECT s.subtype, s.node, s.depth, count(DISTINCT x.node)::BIGINT AS size FROM (
    SELECT 'metric_upstream' AS subtype, metric_id AS node, unnest([3, 6]) AS depth FROM {metrics} WHERE formula IS NOT NULL
    UNION ALL SELECT 'report_upstream', report_id, unnest([2, 3, 6]) FROM {reports} WHERE status = 'active') s
  LEFT JOIN {dist_up} x ON x.seed = s.node AND x.d <= s.depth GROUP BY ALL
  UNION ALL
  SELECT 'staging_downstream', s.node, s.depth, count(DISTINCT r.report_id)::BIGINT FROM (
    SELECT table_id AS node, unnest([2, 3, 4, 6]) AS depth FROM {tables} WHERE layer = 'staging') s
  JOIN {dist_down} x ON x.seed = s.node AND x.d <= s.depth - 1
  LEFT JOIN {redges} r ON r.table_id = x.node GROUP BY ALL""")


@query("lineage_targets", "SELECT subtype, node, depth::BIGINT AS depth, size FROM {lsizes} WHERE depth < 6 AND size BETWEEN 2 AND 15")
def lineage_targets(spark, sf):
    return curation.lineage_targets(sizes(spark, sf)).withColumn("depth", F.col("depth").cast("bigint"))


@query("lineage_pool_stats", """
WITH n AS (SELECT subtype, node, bool_or(depth < 6 AND size BETWEEN 2 AND 15) AS kept,
    max(size) FILTER (depth < 6) AS largest, max(size) FILTER (depth = 6) AS full_size FROM {lsizes} GROUP BY ALL),
  m AS (SELECT subtype, kept, list_sort(list(full_size))[count(*) // 2 + 1] AS med FROM n GROUP BY ALL)
SELECT subtype, count(*)::BIGINT AS candidates, count(*) FILTER (kept)::BIGINT AS kept_n,
  count(*) FILTER (NOT kept AND largest < 2)::BIGINT AS too_few, count(*) FILTER (NOT kept AND largest >= 2)::BIGINT AS too_many,
  (SELECT med FROM m WHERE m.subtype = n.subtype AND m.kept) AS kept_median,
  (SELECT med FROM m WHERE m.subtype = n.subtype AND NOT m.kept) AS removed_median FROM n GROUP BY 1""")
def lineage_pool_stats(spark, sf):
    return curation.lineage_pool_stats(sizes(spark, sf))


TOPIC_TEMPLATE = "Did anybody look at {topic} before?"


def topic_texts(spark, sf):
    return catalog(spark, sf).requests.select("request_id", F.concat_ws(" ", "title", "description").alias("text"))


def request_phrases(spark, sf):
    """Three phrases per topic: a neutral one, and the titles of its first and second request."""
    docs = source(spark, sf, "documents")
    keyed = docs.selectExpr("format_string('T-%05d', doc_id div 4) AS topic_key", "doc_id", "split(text, '\\n')[0] AS title")
    titles = keyed.where("doc_id % 4 < 2").select("topic_key", F.col("title").alias("phrase"))
    neutral = keyed.select("topic_key", F.concat(F.lit("matter "), "topic_key").alias("phrase")).distinct()
    return neutral.union(titles)


_TF = f"list_filter({word_set_sql('question')}, lambda w: w NOT IN ('did', 'anybody', 'look', 'at', 'before') AND w NOT IN {FUNCTIONS})"
view("topic_pool", f"""
  SELECT topic_key, question, coalesce(len(list_filter(c, lambda w: list_contains(words, w)))::DOUBLE / nullif(len(c), 0), 0) AS overlap
  FROM (SELECT q.topic_key, q.question, {_TF} AS c, t.words FROM (
      SELECT DISTINCT topic_key, replace('{TOPIC_TEMPLATE}', '{{topic}}', phrase) AS question FROM (
        SELECT printf('T-%05d', doc_id // 4) AS topic_key, 'matter ' || printf('T-%05d', doc_id // 4) AS phrase FROM documents
        UNION ALL SELECT printf('T-%05d', doc_id // 4), string_split(text, chr(10))[1] FROM documents WHERE doc_id % 4 < 2) x) q
    JOIN (SELECT topic_key, list(DISTINCT w) AS words FROM (SELECT topic_key, unnest({word_set_sql("title || ' ' || description")}) AS w
      FROM {{requests}} JOIN {{topics}} USING (request_id)) y GROUP BY 1) t USING (topic_key)) z""".replace("{{requests}}", "{requests}").replace("{{topics}}", "{topics}"))


@query("topic_targets", f"""
SELECT topic_key, question, round(overlap, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY topic_key
  ORDER BY {h('question')}, question) AS rn FROM {{topic_pool}} WHERE overlap <= 0.2) x WHERE rn = 1""".replace("{{", "{").replace("}}", "}"))
def topic_targets(spark, sf):
    found = curation.topic_targets(
        topics(spark, sf), topic_texts(spark, sf), request_phrases(spark, sf), TOPIC_TEMPLATE, SEED
    )
    return found.withColumn("overlap", F.round("overlap", 6))


view("itargets", """
  SELECT s.table_id, 'individual' AS subtype, CASE WHEN t.layer = 'mart' THEN 'mart' ELSE 'other' END AS layer, NULL AS head_set
  FROM {isummary} s JOIN {tables} t USING (table_id) WHERE notify_total_count BETWEEN 2 AND 20
  UNION ALL SELECT table_id, 'broadcast', NULL, string_agg(record_id, ',' ORDER BY record_id) FILTER (NOT forbidden)
  FROM {gold_notify} WHERE min_mentioned_count IS NOT NULL GROUP BY 1 HAVING bool_or(forbidden)""")


@query("impact_targets", "SELECT table_id, subtype, layer, head_set FROM {itargets}")
def impact_targets(spark, sf):
    return curation.impact_targets(catalog(spark, sf))


@query("broadcast_plan", f"""
SELECT head_set, count(*)::BIGINT AS tables, arg_min(table_id, ({h('table_id')}, table_id)) AS table_id,
  list_contains(string_split(head_set, ','), 'EMP-0000')::BIGINT AS names_root
FROM {{itargets}} WHERE subtype = 'broadcast' GROUP BY head_set ORDER BY 4, {h('head_set')}, head_set LIMIT 3""".replace("{{", "{").replace("}}", "}"))
def broadcast_plan(spark, sf):
    plan = curation.broadcast_plan(curation.impact_targets(catalog(spark, sf)), "EMP-0000", 3, SEED)
    return plan.withColumn("names_root", F.col("names_root").cast("bigint"))


def abstain_parts(spark, sf):
    cat = catalog(spark, sf)
    target = lambda df, c: df.select(F.col(c).alias("target"))
    active = curation.active_reports(cat, noise(spark, sf))
    return {
        "salary": target(cat.employees.where("status = 'active'"), "employee_id"),
        "budget_2027": target(source(spark, sf, "region"), "r_name"),
        "accuracy": target(active, "report_id"),
        "near_miss": target(
            curation.negative_names(fragments(spark, sf), PREFIXES, FORMATS, asset_corpus(spark, sf).names), "name"),
        "never_done": target(source(spark, sf, "nation"), "n_name"),
        "null_formula": target(cat.metrics.where("formula IS NULL"), "metric_id"),
        "future": target(active, "report_id"),
    }


@query("abstain_targets", f"""
SELECT subtype, target, place::BIGINT AS place FROM (SELECT *, row_number() OVER (PARTITION BY subtype
    ORDER BY {h('target')}, target) AS place FROM (
  SELECT 'salary' AS subtype, employee_id AS target FROM {{employees}} WHERE status = 'active'
  UNION ALL SELECT 'budget_2027', r_name FROM region
  UNION ALL SELECT s, report_id FROM {{reports}}, (SELECT unnest(['accuracy', 'future']) AS s) z
    WHERE status = 'active' AND report_id NOT IN (SELECT report_id FROM {{noise}})
  UNION ALL SELECT 'near_miss', name FROM {{negatives}} UNION ALL SELECT 'never_done', n_name FROM nation
  UNION ALL SELECT 'null_formula', metric_id FROM {{metrics}} WHERE formula IS NULL) x) y WHERE place <= 3""".replace("{{", "{").replace("}}", "}"))
def abstain_targets(spark, sf):
    found = curation.abstain_targets(abstain_parts(spark, sf), 3, SEED)
    return found.withColumn("place", F.col("place").cast("bigint"))


@query("chained_targets", """
SELECT 'metric_owners' AS subtype, metric_id AS target, NULL AS step_target FROM {metrics} WHERE formula IS NOT NULL
  AND metric_id NOT IN (SELECT m.metric_id FROM {medges} m JOIN {isummary} s USING (table_id) WHERE s.notify_mode = 'broadcast')
UNION ALL SELECT 'deprecated_replacement', a.report_id, b.report_id FROM {reports} a JOIN {reports} b
  ON b.report_id = a.replaced_by_report_id WHERE a.status = 'deprecated' AND b.status = 'active'
UNION ALL SELECT 'request_report', t.topic_key, min(q.resulting_report_id) FROM {topics} t JOIN {requests} q USING (request_id)
  WHERE q.resulting_report_id IS NOT NULL GROUP BY t.topic_key HAVING count(DISTINCT q.resulting_report_id) = 1
  AND min(q.resulting_report_id) IN (SELECT report_id FROM {reports} WHERE status = 'active')""")
def chained_targets(spark, sf):
    return curation.chained_targets(catalog(spark, sf), topics(spark, sf))


PLAN = [("test", "L5", 6), ("dev", "L5", 2), ("test", "L2", 6), ("dev", "L2", 2), ("test", "L1", 6), ("dev", "L1", 2)]
ORDER = ["L5", "L2", "L1"]


def target_pool(spark, sf):
    """Tables compete for three categories: all, those with a departed owner, those of the marts."""
    cat = catalog(spark, sf)
    gone = cat.employees.where("status = 'left'").select(F.col("employee_id").alias("owner_id"))
    target = F.col("table_id").alias("target")
    return (
        cat.tables.select(F.lit("L1").alias("category"), target)
        .union(cat.tables.join(gone, "owner_id", "left_semi").select(F.lit("L2"), target))
        .union(cat.tables.where("layer = 'mart'").select(F.lit("L5"), target))
    )


def _choice(category: str, pool: str, used: str) -> str:
    order = f"md5('{SEED}:{category}:' || table_id)"
    where = f"WHERE table_id NOT IN (SELECT target FROM {used})" if used else ""
    return (f"SELECT CASE WHEN p <= 6 THEN 'test' ELSE 'dev' END AS set, '{category}' AS category, table_id AS target FROM ("
            f"SELECT table_id, row_number() OVER (ORDER BY {order}, table_id) AS p FROM ({pool}) x {where}) y WHERE p <= 8")


@query("allocate_targets", f"""
WITH c5 AS ({_choice("L5", "SELECT table_id FROM {tables} WHERE layer = 'mart'", "")}),
c2 AS ({_choice("L2", "SELECT t.table_id FROM {tables} t JOIN {employees} e ON e.employee_id = t.owner_id WHERE e.status = 'left'", "c5")}),
u AS (SELECT target FROM c5 UNION ALL SELECT target FROM c2),
c1 AS ({_choice("L1", "SELECT table_id FROM {tables}", "u")})
SELECT * FROM c5 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c1""")
def allocate_targets(spark, sf):
    return curation.allocate_targets(target_pool(spark, sf), PLAN, ORDER, SEED)


@query("dev_test_disjoint", "SELECT table_id AS target FROM {tables} WHERE owner_id IN"
       " (SELECT employee_id FROM {employees} WHERE status = 'left')")
def dev_test_disjoint(spark, sf):
    pool = target_pool(spark, sf)
    return curation.shared_targets(pool.where("category = 'L2'"), pool.where("category = 'L1'"))


@query("stratified_review_sample", """
SELECT category, item_id, place::BIGINT AS place FROM (SELECT *, row_number() OVER (PARTITION BY category
    ORDER BY (rn > 1)::INT, item_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY category, subtype
    ORDER BY item_id) AS rn FROM {items}) x) y WHERE place <= 3""")
def stratified_review_sample(spark, sf):
    return curation.review_sample(items(spark, sf)).select(
        "category", "item_id", F.col("place").cast("bigint").alias("place")
    )


# A retrieval set with flaws on purpose: queries are report names or neutral phrases.
view("rset", """
  SELECT report_id AS item_id, report_id AS target_id, CASE k % 4 WHEN 0 THEN 'E' WHEN 1 THEN 'P' WHEN 2 THEN 'D' ELSE 'N' END AS type,
    CASE WHEN k % 3 = 0 THEN name ELSE 'numbers ' || (k // 2) END AS query FROM {reports}""")


def retrieval_set(spark, sf):
    number = F.split("report_id", "-")[1].cast("bigint")
    return catalog(spark, sf).reports.select(
        F.col("report_id").alias("item_id"), F.col("report_id").alias("target_id"),
        F.element_at(F.array(*[F.lit(t) for t in "EPDN"]), (number % 4 + 1).cast("int")).alias("type"),
        F.when(number % 3 == 0, F.col("name")).otherwise(
            F.concat(F.lit("numbers "), F.floor(number / 2).cast("string"))).alias("query"),
    )


_RQ = f"list_filter({word_set_sql('i.query')}, lambda w: w <> 'numbers' AND w NOT IN {FUNCTIONS})"


@query("validate_retrieval_set", rows_sql({
    "count_per_type": "SELECT type AS record FROM {rset} GROUP BY 1 HAVING count(*) <> 3750",
    "duplicate_query": "SELECT min(item_id) AS record FROM {rset} GROUP BY query HAVING count(*) > 1",
    "name_overlap": f"SELECT i.item_id AS record FROM {{rset}} i JOIN {{reports}} r ON r.report_id = i.target_id WHERE type = 'P'"
    f" AND coalesce(len(list_intersect({word_set_sql('r.name')}, {word_set_sql('i.query')}))::DOUBLE / nullif(len({word_set_sql('r.name')}), 0), 0) > 0.3",
    "description_overlap": f"SELECT i.item_id AS record FROM {{rset}} i JOIN {{reports}} r ON r.report_id = i.target_id WHERE type = 'P'"
    f" AND coalesce(len(list_filter({_RQ}, lambda w: list_contains({word_set_sql('r.description || chr(32) || r.tags')}, w)))::DOUBLE"
    f" / nullif(len({_RQ}), 0), 0) > 0.2",
    "shared_topic": "SELECT item_id AS record FROM {rset} WHERE type = 'P' AND target_id NOT IN (SELECT report_id FROM {alone})",
    "target_active": "SELECT i.item_id AS record FROM {rset} i JOIN {reports} r ON r.report_id = i.target_id WHERE type = 'D'"
    " AND r.status <> 'active'",
}))
def validate_retrieval_set(spark, sf):
    return curation.validate_retrieval_set(
        catalog(spark, sf), retrieval_set(spark, sf), curation.unique_combos(traits(spark, sf)), 3750, ["numbers"]
    )


@query("validate_question_set", rows_sql({
    "count_per_category": "SELECT category AS record FROM {items} GROUP BY 1 HAVING count(*) <> 80",
    "duplicate_item_id": "SELECT item_id AS record FROM {items} GROUP BY 1 HAVING count(*) > 1",
    "duplicate_question": "SELECT question AS record FROM {rules} GROUP BY 1 HAVING count(*) > 1",
    "gold_matches_spec": "SELECT item_id AS record FROM {items} WHERE i % 20 = 1 AND len(gold_ids) > 0",
    "scoring_rule": "SELECT item_id AS record FROM {rules} WHERE scoring IS NULL",
    "id_in_question": "SELECT item_id AS record FROM {rules} WHERE i % 10 = 3 AND len(gold_ids) > 0",
    "must_abstain": "SELECT item_id AS record FROM {items} WHERE category = 'L6' AND NOT should_abstain",
    "empty_gold": "SELECT item_id AS record FROM {items} WHERE category <> 'L6' AND len(gold_ids) = 0",
}))
def validate_question_set(spark, sf):
    made = items(spark, sf)
    # Recomputed gold that lost its first ID for one question in twenty.
    fresh = made.select("item_id", F.expr(
        "CASE WHEN i % 20 = 1 AND size(gold_ids) > 0 THEN slice(gold_ids, 2, size(gold_ids)) ELSE gold_ids END"
    ).alias("gold_ids"))
    plan = spark.createDataFrame([(c, 80) for c in CATEGORIES], "category string, n bigint")
    return curation.validate_question_set(made, plan, fresh)


@query("test_set_notes", """
SELECT 'depth' AS note, depth::BIGINT AS value, count(*)::BIGINT AS n FROM {items}
  WHERE gold_type IN ('upstream_tables', 'downstream_reports') GROUP BY ALL
UNION ALL SELECT 'broadcast size', len(gold_ids)::BIGINT, count(*)::BIGINT FROM {items}
  WHERE gold_type = 'impact_notify' AND subtype = 'broadcast' GROUP BY ALL""")
def test_set_notes(spark, sf):
    return curation.set_notes(items(spark, sf))


