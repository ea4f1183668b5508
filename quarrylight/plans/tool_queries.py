"""Queries over scalar functions, record cards, lookups and argument checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarrylight.functions import scalars, text, vectors
from quarrylight.operators import impact, records, tools
from quarrylight.plans.bindings import catalog, source
from quarrylight.plans.oracle_views import view
from quarrylight.plans.quality_queries import jaccard_sql
from quarrylight.plans.registry import query
from quarrylight.plans.run_bindings import items
from quarrylight.plans.search_views import FUNCTIONS, word_set_sql
from quarrylight.sources.catalog import assets, metric_sources
from quarrylight.sources.embeddings import embed_texts, extend_store
from quarrylight.sources.staging import staging_dir

DEPARTMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def documents(spark, sf):
    return source(spark, sf, "documents")


# ------------------------------------------------------------------ text


@query("word_set", f"SELECT doc_id, array_to_string(list_sort({word_set_sql('text')}), ' ') AS words FROM documents")
def word_set(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.array_join(F.array_sort(text.word_set(F.col("text"))), " ").alias("words")
    )


# Every document is compared with the next one.
view("doc_pairs", """
  SELECT a.doc_id AS a, b.doc_id AS b, a.text AS text_a, b.text AS text_b,
    string_split(a.text, chr(10))[1] AS name_a FROM documents a JOIN documents b
    ON b.doc_id = a.doc_id + 1""")


def doc_pairs(spark, sf):
    left = documents(spark, sf).selectExpr(
        "doc_id AS a", "doc_id + 1 AS b", "text AS text_a", "split(text, '\\n')[0] AS name_a"
    )
    right = documents(spark, sf).selectExpr("doc_id AS b", "text AS text_b")
    return left.join(right, "b")


@query("jaccard", "SELECT a, b, round(coalesce(%s, 0), 6) AS similarity FROM {doc_pairs}" % jaccard_sql(
    word_set_sql("text_a"), word_set_sql("text_b")))
def jaccard(spark, sf):
    value = text.jaccard(text.word_set(F.col("text_a")), text.word_set(F.col("text_b")))
    return doc_pairs(spark, sf).select("a", "b", F.round(value, 6).alias("similarity"))


@query("name_overlap", f"""
SELECT a, b, round(coalesce(len(list_intersect({word_set_sql('name_a')}, {word_set_sql('text_b')}))::DOUBLE
  / nullif(len({word_set_sql('name_a')}), 0), 0), 6) AS overlap FROM {{doc_pairs}}""".replace("{{", "{").replace("}}", "}"))
def name_overlap(spark, sf):
    value = text.name_overlap(F.col("text_b"), F.col("name_a"))
    return doc_pairs(spark, sf).select("a", "b", F.round(value, 6).alias("overlap"))


# Question templates whose own words do not count as content.
TEMPLATES = ["Which report shows {topic} by {dimension}?", "the que de {subject} and is"]
FRAME = ["report", "shows", "que", "de"]
_CONTENT = (f"list_filter({word_set_sql('name_a')}, lambda w: w NOT IN ('report', 'shows', 'que', 'de')"
            f" AND w NOT IN {FUNCTIONS})")


@query("content_overlap", f"""
SELECT a, b, round(coalesce(len(list_filter({_CONTENT}, lambda w: list_contains({word_set_sql('text_b')}, w)))::DOUBLE
  / nullif(len({_CONTENT}), 0), 0), 6) AS overlap FROM {{doc_pairs}}""".replace("{{", "{").replace("}}", "}"))
def content_overlap(spark, sf):
    value = text.content_overlap(F.col("name_a"), F.col("text_b"), text.words_array(FRAME))
    return doc_pairs(spark, sf).select("a", "b", F.round(value, 6).alias("overlap"))


@query("frame_words", f"""
SELECT DISTINCT w AS word FROM (SELECT unnest({word_set_sql("regexp_replace(t, '\\{[a-z_]+\\}', ' ', 'g')")}) AS w
  FROM (SELECT question || ' {{topic}}' AS t FROM {{rules}}) x) y""".replace("{{rules}}", "{rules}").replace("{{topic}}", "{topic}"))
def frame_words(spark, sf):
    templates = items(spark, sf).select(F.concat("question", F.lit(" {topic}")).alias("t"))
    return templates.select(F.explode(text.template_words(F.col("t"))).alias("word")).distinct()


# Free text holding record IDs, some of them unknown.
view("id_texts", """
  SELECT event_id, 'see ' || printf('EMP-%04d', user_id) || ' or RPT-' || printf('%04d', event_id)
    || ', not XRPT-0001 or EMP-12 but ' || printf('EMP-%04d', user_id) || '.' AS text,
    printf('EMP-%04d', user_id) AS emp, printf('RPT-%04d', event_id) AS rpt FROM events""")


def id_texts(spark, sf):
    return source(spark, sf, "events").selectExpr(
        "event_id",
        "concat('see ', format_string('EMP-%04d', user_id), ' or RPT-', format_string('%04d', event_id),"
        " ', not XRPT-0001 or EMP-12 but ', format_string('EMP-%04d', user_id), '.') AS text",
        "format_string('EMP-%04d', user_id) AS emp", "format_string('RPT-%04d', event_id) AS rpt",
    )


@query("extract_record_ids", "SELECT event_id, emp || ',' || rpt || ',' || emp AS ids FROM {id_texts}")
def extract_record_ids(spark, sf):
    return id_texts(spark, sf).select(
        "event_id", F.array_join(text.record_ids(F.col("text")), ",").alias("ids")
    )


@query("dedupe_ordered", "SELECT event_id, emp || ',' || rpt AS ids FROM {id_texts}")
def dedupe_ordered(spark, sf):
    return id_texts(spark, sf).select(
        "event_id", F.array_join(F.array_distinct(text.record_ids(F.col("text"))), ",").alias("ids")
    )


@query("redact_unverified", """
SELECT event_id, regexp_replace(text, '\\b' || rpt || '\\b', '[unverified]', 'g') AS text FROM {id_texts}""")
def redact_unverified(spark, sf):
    return id_texts(spark, sf).select("event_id", text.redact(F.col("text"), F.array("rpt")).alias("text"))


@query("snippet", "SELECT doc_id, CASE WHEN length(text) > 160 THEN substr(text, 1, 157) || '...' ELSE text END"
       " AS snippet FROM documents")
def snippet(spark, sf):
    return documents(spark, sf).select("doc_id", text.snippet(F.col("text")).alias("snippet"))


# RE2 has no look-behind: a border is the start of the line or one more character before.
_SECRETS = {
    "sk- style API key": r"(^|[^A-Za-z0-9])sk-[A-Za-z0-9_\-]{20,}",
    "Hugging Face token": r"(^|[^A-Za-z0-9])hf_[A-Za-z0-9]{30,}",
    "GitHub token": r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,})",
    "AWS access key id": r"\bAKIA[0-9A-Z]{16}\b",
    "Google API key": r"\bAIza[0-9A-Za-z_\-]{35}\b",
    "private key block": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "*_KEY assignment": r"[A-Z0-9_]*_KEY\s*[=:]\s*[\"'']?[A-Za-z0-9+/_\-]{30,}",
}
SECRET_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches({{t}}, '{p}') THEN '{k}' END" for k, p in _SECRETS.items()
) + "], lambda k: k IS NOT NULL)"


def secret_sql(column: str) -> str:
    return SECRET_SQL.replace("{t}", column)


def noted_texts(spark, sf):
    """The documents with the tokens they hold written as key assignments."""
    return documents(spark, sf).withColumn("text", F.replace("text", F.lit("token ="), F.lit("API_KEY =")))


view("noted", "SELECT * REPLACE (replace(text, 'token =', 'API_KEY =') AS text) FROM documents")


@query("secret_kind", f"SELECT doc_id, array_to_string({secret_sql('text')}, ',') AS kinds FROM {{noted}}")
def secret_kind(spark, sf):
    return noted_texts(spark, sf).select(
        "doc_id", F.array_join(scalars.secret_kinds(F.col("text")), ",").alias("kinds")
    )


def markdown_pages(spark, sf):
    """Pages with their anchors written as markdown links."""
    return source(spark, sf, "pages").select(
        "page_id", "url",
        F.regexp_replace("html", r'<a href="([^"]*)">([^<]*)</a>', "[$2]($1)").alias("body"),
    )


view("page_links", r"""
  SELECT page_id, url, i, link, CASE WHEN regexp_matches(link, '^https?://') THEN 'external'
    WHEN link LIKE '#%' OR link LIKE 'mailto:%' THEN 'ignored' ELSE 'local' END AS kind
  FROM (SELECT page_id, url, unnest(links) AS link, unnest(range(len(links))) AS i FROM (
    SELECT page_id, url, regexp_extract_all(regexp_replace(html, '<a href="([^"]*)">([^<]*)</a>', '[\2](\1)', 'g'),
      '!?\[[^\]]*\]\(([^)\s]+)\)', 1) AS links FROM pages) x) y""")


@query("markdown_links", "SELECT page_id, i::BIGINT AS pos, link AS target, kind FROM {page_links}")
def markdown_links(spark, sf):
    found = markdown_pages(spark, sf).select(
        "page_id", F.posexplode(scalars.markdown_links(F.col("body"))).alias("pos", "target")
    )
    return found.select(
        "page_id", F.col("pos").cast("bigint"), "target",
        scalars.link_kind(F.col("target")).alias("kind"),
    )


@query("content_key", "SELECT doc_id, sha256('6:hash64|2:64|' || length(text) || ':' || text) AS text_key FROM documents")
def content_key(spark, sf):
    key = scalars.content_key(F.lit("hash64"), F.lit("64"), F.col("text"))
    return documents(spark, sf).select("doc_id", key.alias("text_key"))


def model_messages(spark, sf):
    """Final messages: bare JSON, fenced JSON, JSON inside prose, and broken ones."""
    body = (
        "concat('{\"answer\": \"user ', user_id, '\", \"answer_ids\": [\" RPT-', event_id, '\", \"RPT-', event_id,"
        " '\", \"\"], \"evidence_ids\": [], \"abstained\": ', CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END, '}')"
    )
    return source(spark, sf, "events").selectExpr(
        "event_id",
        f"CASE event_id % 6 WHEN 0 THEN {body} WHEN 1 THEN concat('```json\\n', {body}, '\\n```')"
        f" WHEN 2 THEN concat('Here you are: ', {body}, ' Thanks.')"
        " WHEN 3 THEN concat('no object ', event_id) WHEN 4 THEN '{\"answer\": \"x\", \"answer_ids\": []}'"
        " ELSE '' END AS message",
    )


@query("parse_final_answer", """
SELECT event_id, CASE WHEN event_id % 6 < 3 THEN 'user ' || user_id END AS answer,
  CASE WHEN event_id % 6 < 3 THEN 'RPT-' || event_id END AS answer_ids,
  CASE WHEN event_id % 6 < 3 THEN event_type = 'error' END AS abstained FROM events""")
def parse_final_answer(spark, sf):
    parsed = model_messages(spark, sf).select(
        "event_id", scalars.parse_final_answer(F.col("message")).alias("a")
    )
    return parsed.select(
        "event_id", "a.answer", F.array_join("a.answer_ids", ",").alias("answer_ids"), "a.abstained"
    )


@query("infer_declared_type", """
SELECT word, CASE WHEN regexp_matches(word, '^(is_|has_)') OR word LIKE '%~_flag' ESCAPE '~' THEN 'boolean'
  WHEN word LIKE '%~_key' ESCAPE '~' THEN 'integer'
  WHEN word LIKE '%~_id' ESCAPE '~' OR word LIKE '%~_code' ESCAPE '~' OR word IN ('vin', 'part_number') THEN 'string'
  WHEN word LIKE '%~_date' ESCAPE '~' THEN 'date' WHEN word LIKE '%~_at' ESCAPE '~' THEN 'timestamp'
  WHEN contains(word, 'hours') THEN 'decimal(9,2)'
  WHEN regexp_matches(word, 'amount|price|revenue|cost|value') THEN 'decimal(18,2)'
  WHEN word LIKE '%~_score' ESCAPE '~' THEN 'decimal(5,2)'
  WHEN regexp_matches(word, '(_qty|_count|_days|_minutes|_year|_quarter|_month|_week|_level|units|_since_purchase)$')
    OR word LIKE 'days~_%' ESCAPE '~' THEN 'integer' ELSE 'string' END AS declared
FROM (SELECT DISTINCT w || s AS word FROM
  (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) a,
  (SELECT unnest(['_flag', '_key', '_id', '_code', '_date', '_at', '_hours', '_price', '_score', '_qty', '_units', '']) AS s) b) x""")
def infer_declared_type(spark, sf):
    suffixes = ["_flag", "_key", "_id", "_code", "_date", "_at", "_hours", "_price", "_score", "_qty", "_units", ""]
    words = source(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("w")).select(
        F.explode(F.array(*[F.concat("w", F.lit(s)) for s in suffixes])).alias("word")
    ).distinct()
    return words.select("word", scalars.declared_type(F.col("word")).alias("declared"))


@query("parse_packed_fields", """
SELECT table_id AS id, array_to_string(regexp_extract_all(columns_json, '"name":"([^"]*)"', 1), ',') AS parts,
  'columns' AS kind FROM {tables}
UNION ALL SELECT report_id, replace(tags, '|', ','), 'tags' FROM {reports}
UNION ALL SELECT metric_id, replace(aliases, '|', ','), 'aliases' FROM {metrics}
UNION ALL SELECT metric_id, array_to_string(sources, ','), 'sources' FROM {metrics}""")
def parse_packed_fields(spark, sf):
    cat = catalog(spark, sf)
    names = F.transform(scalars.json_columns(F.col("columns_json")), lambda c: c["name"])
    parts = [
        cat.tables.select(F.col("table_id").alias("id"), F.array_join(names, ",").alias("parts"),
                          F.lit("columns").alias("kind")),
        cat.reports.select("report_id", F.array_join(scalars.packed_list(F.col("tags")), ","), F.lit("tags")),
        cat.metrics.select("metric_id", F.array_join(scalars.packed_list(F.col("aliases")), ","), F.lit("aliases")),
        cat.metrics.select("metric_id", F.array_join(scalars.json_ids(F.col("source_table_ids")), ","),
                           F.lit("sources")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("pacific_day", """
SELECT event_id, (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles')::DATE AS day FROM events""")
def pacific_day(spark, sf):
    return source(spark, sf, "events").select(
        "event_id", scalars.quota_day(F.col("ts").cast("timestamp")).alias("day")
    )


# ------------------------------------------------------------------ vectors


@query("l2_normalize", """
SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / n)), 6) + 0.0::DOUBLE AS component_sum,
  round(list_sum(list_transform(e, lambda x: (x / n) * (x / n))), 6) AS squared_length
FROM (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS e FROM embeddings) x) y""")
def l2_normalize(spark, sf):
    scaled = source(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("e")
    )
    unit = scaled.select("vec_id", vectors.l2_normalize(F.col("e")).alias("u"))
    return unit.select(
        "vec_id",
        F.round(F.aggregate("u", F.lit(0.0), lambda t, x: t + x), 6).alias("component_sum"),
        F.round(vectors.dot_product(F.col("u"), F.col("u")), 6).alias("squared_length"),
    )


@query("dot_product", """
SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0::DOUBLE AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def dot_product(spark, sf):
    left = source(spark, sf, "embeddings").selectExpr("vec_id AS a", "vec_id + 1 AS b", "embedding AS ea")
    right = source(spark, sf, "embeddings").selectExpr("vec_id AS b", "embedding AS eb")
    return left.join(right, "b").select(
        "a", "b", F.round(vectors.dot_product(F.col("ea"), F.col("eb")), 6).alias("cosine")
    )


_SPLIT = "list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')"
_WORD_BUCKETS = f"""
  SELECT {{k}}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS bucket,
    sum(CASE WHEN ('0x' || substr(md5(w), 9, 2))::BIGINT % 2 = 1 THEN 1 ELSE -1 END) AS v
  FROM (SELECT {{k}}, unnest({_SPLIT}) AS w FROM {{t}}) x GROUP BY ALL HAVING v <> 0"""


@query("embed_texts", f"""
SELECT item_id, count(*)::BIGINT AS nonzero, round(sum(v * (bucket + 1)) / sqrt(sum(v * v)), 6) + 0.0::DOUBLE AS weighted_sum
FROM ({_WORD_BUCKETS.replace('{k}', 'item_id').replace('{t}', 'benchmark')}) y GROUP BY 1""")
def embedded(spark, sf):
    found = embed_texts(source(spark, sf, "benchmark"), "item_id", "text", dim=64)
    spread = found.select("item_id", F.posexplode("embedding").alias("bucket", "v")).where("v <> 0")
    return spread.groupBy("item_id").agg(
        F.count("*").alias("nonzero"),
        F.round(F.sum(F.col("v") * (F.col("bucket") + 1)), 6).alias("weighted_sum"),
    )


@query("embedding_store", """
SELECT DISTINCT sha256('6:hash64|2:64|' || length(text) || ':' || text) AS text_key, 'hash64' AS model
FROM (SELECT text FROM benchmark UNION ALL SELECT text FROM documents)""")
def embedding_store(spark, sf):
    path = f"{staging_dir(spark)}/vectors-{uuid.uuid4().hex}"
    for name in ("benchmark", "documents", "documents"):
        stored = extend_store(path, source(spark, sf, name), "text", "hash64", dim=64)
    return stored.select("text_key", "model")


# ------------------------------------------------------------------ lookups and arguments


def asked_records(spark, sf):
    """One lookup per event: known, unknown and malformed IDs of all kinds."""
    return source(spark, sf, "events").selectExpr(
        "event_id AS request_id",
        "CASE event_id % 7 WHEN 0 THEN format_string('RPT-%04d', event_id) WHEN 1 THEN format_string('TBL-%04d', event_id)"
        " WHEN 2 THEN format_string('EMP-%04d', user_id) WHEN 3 THEN format_string('MET-%04d', event_id % 200)"
        " WHEN 4 THEN format_string('REQ-%04d', event_id) WHEN 5 THEN concat('RPT', event_id)"
        " ELSE concat('xRPT-', event_id) END AS record_id",
    )


view("asked", """
  SELECT event_id AS request_id, CASE event_id % 7 WHEN 0 THEN printf('RPT-%04d', event_id)
    WHEN 1 THEN printf('TBL-%04d', event_id) WHEN 2 THEN printf('EMP-%04d', user_id)
    WHEN 3 THEN printf('MET-%04d', event_id % 200) WHEN 4 THEN printf('REQ-%04d', event_id)
    WHEN 5 THEN 'RPT' || event_id ELSE 'xRPT-' || event_id END AS record_id,
    CASE event_id % 7 WHEN 0 THEN 'report' WHEN 1 THEN 'table' WHEN 2 THEN 'employee' WHEN 3 THEN 'metric'
      WHEN 4 THEN 'request' END AS kind FROM events""")
view("known", """
  SELECT employee_id AS record_id, full_name AS name FROM {employees} UNION ALL SELECT report_id, name FROM {reports}
  UNION ALL SELECT table_id, name FROM {tables} UNION ALL SELECT metric_id, name FROM {metrics}
  UNION ALL SELECT request_id, title FROM {requests}""")


@query("record_type", "SELECT request_id, record_id, kind FROM {asked}")
def record_type(spark, sf):
    return asked_records(spark, sf).select(
        "request_id", "record_id", text.record_type(F.col("record_id")).alias("kind")
    )


@query("is_asset", "SELECT request_id, coalesce(kind IN ('report', 'table', 'metric'), false) AS is_asset FROM {asked}")
def is_asset(spark, sf):
    kind = text.record_type(F.col("record_id"))
    return asked_records(spark, sf).select(
        "request_id", F.coalesce(kind.isin(tools.ASSET_KINDS), F.lit(False)).alias("is_asset")
    )


_LOOKUP = """
SELECT a.request_id, a.record_id, a.kind, k.name, CASE WHEN a.kind IS NULL THEN 'INVALID_ARGUMENT'
  WHEN k.record_id IS NULL THEN 'NOT_FOUND' END AS error FROM {asked} a LEFT JOIN {known} k USING (record_id)"""


@query("lookup_record", _LOOKUP)
def lookup_record(spark, sf):
    return tools.lookup_records(catalog(spark, sf), asked_records(spark, sf))


def _person_sql(alias: str) -> str:
    return f"{{'id': {alias}.employee_id, 'name': {alias}.full_name, 'status': {alias}.status}}"


def _card_sql(fields: str, listed: str, rest: str, limit: int = 4000) -> str:
    """payload and truncated of a card: the longest start of its list with which the JSON fits."""
    card = "to_json({" + fields + ", %s, " + rest + "'truncated': %s})"
    name = listed.split(":")[0]
    size = f"length({card % (name + ': []', 'false')})"
    fits = (f"list_max(list_filter(range(len(items) + 1), lambda k: {size} - (k < len(items))::INT"
            f" + length(array_to_string(list_transform(items[1:k], lambda t: to_json(t)::VARCHAR), ',')) <= {limit}))")
    return (f"{card % (f'{name}: items[1:coalesce({fits}, 0)]', f'coalesce({fits}, 0) < len(items)')}::VARCHAR AS payload,"
            f" coalesce({fits}, 0) < len(items) AS truncated")


_LINKS = ("coalesce((SELECT list({'id': t.table_id, 'name': t.name, 'layer': t.layer} ORDER BY t.table_id) FROM %s x"
          " JOIN {tables} t USING (table_id) WHERE x.%s = c.%s), []) AS items")

view("report_payloads", f"""
  SELECT report_id AS record_id, {_card_sql("'record_type': 'report', 'report_id': report_id, 'name': name, 'workspace': workspace, "
    "'department': department, 'description': description, 'created_date': created_date::VARCHAR, "
    "'last_refresh': last_refresh::VARCHAR, 'refresh_status': refresh_status, 'tags': string_split(tags, '|'), "
    "'usage_30d': usage_30d, 'status': status, 'replaced_by_report_id': replaced_by_report_id, 'owner': owner",
    "'tables':", "")}
  FROM (SELECT c.*, {_person_sql("p")} AS owner, {_LINKS % ("{redges}", "report_id", "report_id")}
    FROM {{reports}} c JOIN {{employees}} p ON p.employee_id = c.owner_id) y""".replace("{{", "{").replace("}}", "}"))
view("table_payloads", f"""
  SELECT table_id AS record_id, {_card_sql("'record_type': 'table', 'table_id': table_id, 'name': name, 'layer': layer, "
    "'source_system': source_system, 'schema_name': schema_name, 'description': description", "'columns':",
    "'row_count': row_count, 'update_frequency': update_frequency, 'owner': owner, 'parent_table_count': parents, "
    "'child_table_count': children, 'downstream_report_count': readers, ")}
  FROM (SELECT c.*, {_person_sql("p")} AS owner, from_json(c.columns_json, '[{{"name":"VARCHAR","type":"VARCHAR"}}]') AS items,
      (SELECT count(*) FROM {{tedges}} x WHERE x.child_table_id = c.table_id) AS parents,
      (SELECT count(*) FROM {{tedges}} x WHERE x.parent_table_id = c.table_id) AS children, s.affected_report_count AS readers
    FROM {{tables}} c JOIN {{employees}} p ON p.employee_id = c.owner_id JOIN {{isummary}} s USING (table_id)) y""".replace(
    "{{", "{").replace("}}", "}"))
view("metric_payloads", f"""
  SELECT metric_id AS record_id, {_card_sql("'record_type': 'metric', 'metric_id': metric_id, 'name': name, "
    "'aliases': string_split(aliases, '|'), 'business_definition': business_definition, 'formula': formula, 'owner': owner",
    "'source_tables':", "")}
  FROM (SELECT c.*, {_person_sql("p")} AS owner, {_LINKS % ("{medges}", "metric_id", "metric_id")}
    FROM {{metrics}} c JOIN {{employees}} p ON p.employee_id = c.owner_id) y""".replace("{{", "{").replace("}}", "}"))
view("payloads", f"""
  SELECT * FROM {{report_payloads}} UNION ALL SELECT * FROM {{table_payloads}} UNION ALL SELECT * FROM {{metric_payloads}}
  UNION ALL SELECT employee_id, to_json({{'record_type': 'employee', 'employee_id': employee_id, 'full_name': full_name,
    'department': department, 'title': title, 'status': status, 'manager_id': manager_id, 'successor_id': successor_id,
    'is_department_head': is_department_head, 'truncated': false}})::VARCHAR, false FROM {{employees}}
  UNION ALL SELECT q.request_id, to_json({{'record_type': 'request', 'request_id': q.request_id, 'title': q.title,
    'description': q.description, 'department': q.department, 'created_date': q.created_date::VARCHAR,
    'closed_date': q.closed_date::VARCHAR, 'status': q.status, 'resulting_report_id': q.resulting_report_id,
    'duplicate_of_request_id': q.duplicate_of_request_id, 'requester': {_person_sql("r")}, 'assignee': {_person_sql("a")},
    'truncated': false}})::VARCHAR, false
  FROM {{requests}} q JOIN {{employees}} r ON r.employee_id = q.requester_id
    JOIN {{employees}} a ON a.employee_id = q.assignee_id""".replace("{{", "{").replace("}}", "}"))


@query("get_record", """
SELECT a.request_id, a.record_id, a.kind, p.payload, p.truncated, CASE WHEN a.kind IS NULL THEN 'INVALID_ARGUMENT'
  WHEN p.record_id IS NULL THEN 'NOT_FOUND' END AS error FROM {asked} a LEFT JOIN {payloads} p USING (record_id)""")
def get_record(spark, sf):
    return records.get_records(catalog(spark, sf), asked_records(spark, sf)).withColumn("error", F.col("error.code"))


@query("impact_answer", """
SELECT a.request_id, a.record_id AS table_id, p.payload, length(p.payload)::BIGINT AS payload_chars, p.truncated,
  CASE WHEN a.kind IS NULL OR a.kind <> 'table' THEN 'INVALID_ARGUMENT' WHEN p.table_id IS NULL THEN 'NOT_FOUND' END AS error
FROM {asked} a LEFT JOIN {ipayloads} p ON p.table_id = a.record_id""")
def impact_answer(spark, sf):
    asked = asked_records(spark, sf).withColumnRenamed("record_id", "table_id")
    return impact.impact_answers(catalog(spark, sf), asked).withColumn("error", F.col("error.code"))


@query("result_or_error", """
SELECT a.request_id, CASE WHEN a.kind IS NULL OR a.kind NOT IN ('report', 'table', 'metric') THEN 'INVALID_ARGUMENT'
  WHEN c.asset_id IS NULL THEN 'NOT_FOUND' END AS error, c.resolved_owner_id, c.reason
FROM {asked} a LEFT JOIN (SELECT s.asset_id, w.resolved_owner_id, w.reason FROM {assets} s JOIN {contacts} w
  ON w.employee_id = s.owner_id) c ON c.asset_id = a.record_id""")
def result_or_error(spark, sf):
    from quarrylight.operators.ownership import resolve_owner

    asked = asked_records(spark, sf).withColumnRenamed("record_id", "asset_id")
    return resolve_owner(catalog(spark, sf), asked).select(
        "request_id", "error", "resolved_owner_id", "reason"
    )


@query("validate_args", """
SELECT event_id, CASE WHEN length(trim(q, ' ')) < 1 THEN 'query' WHEN length(trim(q, ' ')) > 300 THEN 'query'
  WHEN kind NOT IN ('report', 'table', 'metric', 'any') THEN 'asset_type'
  WHEN dept IS NOT NULL AND dept NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY') THEN 'department'
  WHEN k NOT BETWEEN 1 AND 10 THEN 'top_k' END AS bad_field
FROM (SELECT event_id, CASE event_id % 8 WHEN 0 THEN '   ' WHEN 1 THEN repeat('x', 301) ELSE ' sales ' || event_id END AS q,
  CASE event_id % 5 WHEN 0 THEN 'report' WHEN 1 THEN 'dashboard' ELSE 'any' END AS kind,
  CASE event_id % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'NOWHERE' END AS dept, event_id % 13 AS k FROM events) x""")
def validate_args(spark, sf):
    asked = source(spark, sf, "events").selectExpr(
        "event_id",
        "CASE event_id % 8 WHEN 0 THEN '   ' WHEN 1 THEN repeat('x', 301) ELSE concat(' sales ', event_id) END AS query",
        "CASE event_id % 5 WHEN 0 THEN 'report' WHEN 1 THEN 'dashboard' ELSE 'any' END AS asset_type",
        "CASE event_id % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'NOWHERE' END AS department",
        "event_id % 13 AS top_k",
    )
    checked = tools.validate_search_args(asked, DEPARTMENTS)
    return checked.select(
        "event_id", F.nullif(F.regexp_extract("error.message", "'([a-z_]+)'", 1), F.lit("")).alias("bad_field")
    )


@query("model_view", """
SELECT query_id, '{"signal":{"exact_match":' || exact_match || ',"match_quality":"' || match_quality || '"}}' AS payload
FROM {ra_signal}""")
def model_view(spark, sf):
    from quarrylight.plans.search_queries import results

    signal = results(spark, sf, "asset").signal.select(
        "query_id",
        F.struct(
            F.col("query_id").alias("query"),
            F.struct("exact_match", "top_cosine", "dense_z", "match_quality").alias("signal"),
        ).alias("payload"),
    )
    return signal.select("query_id", F.to_json(tools.model_view(F.col("payload"))).alias("payload"))


@query("active_reports", "SELECT report_id FROM {reports} WHERE status = 'active' AND report_id NOT IN"
       " (SELECT unnest([a, b]) FROM {designed})")
def active_reports(spark, sf):
    from quarrylight.operators.curation import active_reports as active
    from quarrylight.plans.quality_queries import designed_pairs

    members = designed_pairs(spark, sf).select(F.explode(F.array("a", "b")).alias("report_id"))
    return active(catalog(spark, sf), members).select("report_id")


# ------------------------------------------------------------------ record cards


@query("record_card_report", """
SELECT r.report_id, r.name, r.department, r.created_date, r.usage_30d, r.status, r.owner_id, e.full_name AS owner_name,
  e.status AS owner_status, replace(r.tags, '|', ',') AS tags, coalesce(l.n, 0)::BIGINT AS table_count,
  coalesce(l.tables, '') AS tables
FROM {reports} r JOIN {employees} e ON e.employee_id = r.owner_id LEFT JOIN (
  SELECT x.report_id, count(*) AS n, string_agg(t.table_id || ' ' || t.layer, ',' ORDER BY t.table_id) AS tables
  FROM {redges} x JOIN {tables} t USING (table_id) GROUP BY 1) l USING (report_id)""")
def record_card_report(spark, sf):
    cards = tools.report_cards(catalog(spark, sf))
    listed = F.array_join(F.transform("tables", lambda t: F.concat_ws(" ", t["id"], t["layer"])), ",")
    return cards.select(
        "report_id", "name", "department", "created_date", "usage_30d", "status", "owner_id",
        "owner_name", "owner_status", F.array_join("tag_list", ",").alias("tags"),
        F.coalesce("linked_count", F.lit(0)).alias("table_count"),
        F.coalesce(listed, F.lit("")).alias("tables"),
    )


@query("record_card_table", """
SELECT t.table_id, t.name, t.layer, e.full_name AS owner_name, s.affected_report_count AS downstream_report_count,
  (SELECT count(*) FROM {tedges} x WHERE x.child_table_id = t.table_id)::BIGINT AS parent_table_count,
  (SELECT count(*) FROM {tedges} x WHERE x.parent_table_id = t.table_id)::BIGINT AS child_table_count,
  len(regexp_extract_all(t.columns_json, '"name"'))::BIGINT AS columns
FROM {tables} t JOIN {employees} e ON e.employee_id = t.owner_id JOIN {isummary} s USING (table_id)""")
def record_card_table(spark, sf):
    cat = catalog(spark, sf)
    downstream = impact.impact_summary(cat).select(
        "table_id", F.col("affected_report_count").alias("downstream_report_count")
    )
    return tools.table_cards(cat, downstream).select(
        "table_id", "name", "layer", "owner_name", "downstream_report_count", "parent_table_count",
        "child_table_count", F.size("columns").cast("bigint").alias("columns"),
    )


@query("record_card_metric", """
SELECT m.metric_id, m.name, m.formula, e.full_name AS owner_name, len(m.sources)::BIGINT AS table_count,
  (SELECT string_agg(t.table_id || ' ' || t.layer, ',' ORDER BY t.table_id) FROM {medges} x JOIN {tables} t USING (table_id)
    WHERE x.metric_id = m.metric_id) AS tables
FROM {metrics} m JOIN {employees} e ON e.employee_id = m.owner_id""")
def record_card_metric(spark, sf):
    cat = catalog(spark, sf)
    cards = tools.metric_cards(cat, metric_sources(cat))
    listed = F.array_join(F.transform("tables", lambda t: F.concat_ws(" ", t["id"], t["layer"])), ",")
    return cards.select(
        "metric_id", "name", "formula", "owner_name", F.col("linked_count").alias("table_count"),
        listed.alias("tables"),
    )


@query("record_card_employee", "SELECT employee_id, full_name, department, title, status, manager_id, successor_id,"
       " is_department_head FROM {employees}")
def record_card_employee(spark, sf):
    return catalog(spark, sf).employees.select(
        "employee_id", "full_name", "department", "title", "status", "manager_id", "successor_id",
        "is_department_head",
    )


@query("record_card_request", """
SELECT q.request_id, q.title, q.status, q.created_date, q.closed_date, r.full_name AS requester_name,
  a.full_name AS assignee_name, a.status AS assignee_status
FROM {requests} q JOIN {employees} r ON r.employee_id = q.requester_id JOIN {employees} a ON a.employee_id = q.assignee_id""")
def record_card_request(spark, sf):
    return tools.request_cards(catalog(spark, sf)).select(
        "request_id", "title", "status", "created_date", "closed_date", "requester_name",
        "assignee_name", "assignee_status",
    )


@query("semi_anti_lookups", """
SELECT record_id, record_id IN (SELECT asset_id FROM {assets}) AS is_known FROM (
  SELECT DISTINCT unnest(gold_ids) AS record_id FROM {items}) x""")
def semi_anti_lookups(spark, sf):
    wanted = items(spark, sf).select(F.explode("gold_ids").alias("record_id")).distinct()
    known = assets(catalog(spark, sf)).select(F.col("asset_id").alias("record_id"))
    found = wanted.join(known, "record_id", "left_semi").withColumn("is_known", F.lit(True))
    missing = wanted.join(known, "record_id", "left_anti").withColumn("is_known", F.lit(False))
    return found.union(missing)


@query("answer_minus_forbidden", """
SELECT item_id, array_to_string(list_sort(list_filter(forbidden_ids, lambda f: NOT list_contains(gold_ids, f))), ',')
  AS forbidden FROM {items}""")
def answer_minus_forbidden(spark, sf):
    left = F.array_sort(F.array_distinct(F.array_except("forbidden_ids", "gold_ids")))
    return items(spark, sf).select("item_id", F.array_join(left, ",").alias("forbidden"))


# ------------------------------------------------------------------ rolling windows


@query("rolling_minute_usage", """
SELECT event_id, count(*) OVER w::BIGINT AS calls, sum(100 + event_id % 900) OVER w::BIGINT AS tokens
FROM events WINDOW w AS (ORDER BY ts RANGE BETWEEN INTERVAL 600 SECONDS PRECEDING AND CURRENT ROW)""".replace(
    "count(*) OVER w::BIGINT", "(count(*) OVER w)::BIGINT").replace(
    "sum(100 + event_id % 900) OVER w::BIGINT", "(sum(100 + event_id % 900) OVER w)::BIGINT"))
def rolling_minute_usage(spark, sf):
    from quarrylight.operators.quota import rolling_usage

    calls = source(spark, sf, "events").selectExpr(
        "event_id", "cast(ts as timestamp) AS ts", "100 + event_id % 900 AS tokens"
    )
    return rolling_usage(calls, seconds=600).select("event_id", "calls", F.col("window_tokens").alias("tokens"))


