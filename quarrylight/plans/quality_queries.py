"""Queries over data-quality rules, look-alike names and catalog profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators import profile, quality, similarity
from quarrylight.plans.bindings import catalog, source
from quarrylight.plans.oracle_views import view
from quarrylight.plans.registry import query
from quarrylight.plans.search_views import word_set_sql

TODAY = "2003-12-31"
ABBREVIATIONS = ["urgent", "machinery"]
FRAGMENTS = ["forecast", "view x1"]
KEYWORDS = ["confidential", "enan"]


def rows_sql(rules: dict[str, str]) -> str:
    """rule -> SQL giving the violating records in a column named record."""
    return "\nUNION ALL ".join(
        f"SELECT '{rule}' AS rule, count(*)::BIGINT AS violations, min(record::VARCHAR) AS sample,"
        f" NULL::DOUBLE AS value FROM ({sql}) x"
        for rule, sql in rules.items()
    )


def share_sql(rule: str, sql: str, low: float, high: float) -> str:
    """A share given as SQL with one column named value."""
    return (
        f"\nUNION ALL SELECT '{rule}', CASE WHEN value BETWEEN {low}::DOUBLE AND {high}::DOUBLE"
        f" THEN 0 ELSE 1 END::BIGINT, NULL, round(value, 6) FROM ({sql}) x"
    )


def rounded(df):
    return df.withColumn("value", F.round("value", 6))


# ------------------------------------------------------------------ facts about the catalog
# The intent behind the data: designed pairs, topics and structures, by plain arithmetic.


def topics(spark, sf):
    """Requests in topic clusters of four."""
    return source(spark, sf, "documents").selectExpr(
        "format_string('REQ-%04d', doc_id) AS request_id",
        "format_string('T-%05d', doc_id div 4) AS topic_key",
    )


def designed_pairs(spark, sf):
    """Near-duplicate report pairs: every thirtieth report and the next one."""
    return source(spark, sf, "orders").where("o_orderkey % 30 = 0").selectExpr(
        "format_string('RPT-%04d', o_orderkey) AS a", "format_string('RPT-%04d', o_orderkey + 1) AS b"
    )


def deprecated_pairs(spark, sf):
    return catalog(spark, sf).reports.where("replaced_by_report_id IS NOT NULL").selectExpr(
        "report_id AS a", "replaced_by_report_id AS b"
    )


def traits(spark, sf):
    """Subject, qualifier and variant of every report."""
    return source(spark, sf, "orders").selectExpr(
        "format_string('RPT-%04d', o_orderkey) AS report_id",
        "concat('subject ', o_orderkey div 3) AS subject",
        "CASE WHEN o_orderkey % 11 = 4 THEN 'region' ELSE lower(substring(o_orderpriority, 3)) END"
        " AS qualifier",
        "CASE WHEN o_orderkey % 30 = 1 THEN CASE WHEN o_orderkey % 4 = 1 THEN 'regional'"
        " ELSE 'detail' END END AS variant",
    )


def vague(spark, sf):
    return source(spark, sf, "orders").where("o_orderkey % 10 = 7").selectExpr(
        "format_string('RPT-%04d', o_orderkey) AS report_id"
    )


def chains(spark, sf):
    """Departed people in designed chains: everybody alone, or with their successor's successor."""
    people = catalog(spark, sf).employees.where("status = 'left'").select("employee_id", "successor_id")
    after = people.select(F.col("employee_id").alias("successor_id"), F.lit(True).alias("goes_on"))
    linked = people.join(after, "successor_id", "left")
    chain = F.when(
        F.col("goes_on"), F.array("employee_id", "successor_id")
    ).otherwise(F.array("employee_id"))
    return linked.select(F.concat(F.lit("C"), F.size(chain)).alias("code"), chain.alias("chain"))


view("topics", "SELECT printf('REQ-%04d', doc_id) AS request_id, printf('T-%05d', doc_id // 4) AS topic_key FROM documents")
view("designed", """
  SELECT printf('RPT-%04d', o_orderkey) AS a, printf('RPT-%04d', o_orderkey + 1) AS b FROM orders
  WHERE o_orderkey % 30 = 0""")
view("traits", """
  SELECT printf('RPT-%04d', o_orderkey) AS report_id, 'subject ' || (o_orderkey // 3) AS subject,
    CASE WHEN o_orderkey % 11 = 4 THEN 'region' ELSE lower(substr(o_orderpriority, 3)) END AS qualifier,
    CASE WHEN o_orderkey % 30 = 1 THEN CASE WHEN o_orderkey % 4 = 1 THEN 'regional' ELSE 'detail' END END
      AS variant FROM orders""")
view("chains", """
  SELECT p.employee_id AS head, s.employee_id AS nxt, CASE WHEN s.employee_id IS NULL
    THEN [p.employee_id] ELSE [p.employee_id, s.employee_id] END AS chain
  FROM {employees} p LEFT JOIN {employees} s ON s.employee_id = p.successor_id AND s.status = 'left'
  WHERE p.status = 'left'""")

_PK = {
    f"{t}.{r}": sql
    for t, key, prefix in (
        ("employees", "employee_id", "EMP"), ("reports", "report_id", "RPT"),
        ("tables", "table_id", "TBL"), ("metrics", "metric_id", "MET"),
        ("requests", "request_id", "REQ"),
    )
    for r, sql in (
        ("unique", f"SELECT {key} AS record FROM {{{t}}} GROUP BY 1 HAVING count(*) > 1"),
        ("format", f"SELECT {key} AS record FROM {{{t}}} WHERE NOT regexp_full_match({key}, '{prefix}-[0-9]{{3,}}')"),
    )
}
_PK["report_table_edges.unique"] = (
    "SELECT report_id || ' ' || table_id AS record FROM {redges} GROUP BY 1 HAVING count(*) > 1")
_PK["table_table_edges.unique"] = (
    "SELECT parent_table_id || ' ' || child_table_id AS record FROM {tedges} GROUP BY 1 HAVING count(*) > 1")


@query("dq_primary_key", rows_sql(_PK))
def dq_primary_key(spark, sf):
    return quality.primary_keys(catalog(spark, sf))


@query("dense_id_sequence", "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, min(k)::BIGINT AS low, max(k)::BIGINT AS high, count(*)::BIGINT AS n,"
    f" min(k) = 0 AND max(k) = count(*) - 1 AND count(DISTINCT k) = count(*) AS is_dense FROM {{{t}}}"
    for t in ("employees", "reports", "tables", "metrics", "requests")))
def dense_id_sequence(spark, sf):
    return quality.dense_sequences(catalog(spark, sf), first=0)


_VIEW = {"report_table_edges": "redges", "table_table_edges": "tedges"}
_FK = {
    f"{t}.{c}": f"SELECT DISTINCT {c} AS record FROM {{{_VIEW.get(t, t)}}} WHERE {c} IS NOT NULL"
    f" AND {c} NOT IN (SELECT {quality.KEYS[to][0]} FROM {{{to}}})"
    for t, c, to in quality.REFERENCES
}
_FK["metrics.source_table_ids"] = (
    "SELECT DISTINCT table_id AS record FROM {medges} WHERE table_id NOT IN (SELECT table_id FROM {tables})")


@query("dq_foreign_keys", rows_sql(_FK))
def dq_foreign_keys(spark, sf):
    return quality.foreign_keys(catalog(spark, sf))


view("below_root", """
  SELECT employee_id FROM (WITH RECURSIVE b(employee_id) AS (
    SELECT min(employee_id) FROM {employees} WHERE manager_id IS NULL
    UNION SELECT e.employee_id FROM b JOIN {employees} e ON e.manager_id = b.employee_id)
    SELECT * FROM b) x""")


@query("dq_tree", rows_sql({
    "single_root": "SELECT employee_id AS record FROM {employees} WHERE manager_id IS NULL AND employee_id >"
    " (SELECT min(employee_id) FROM {employees} WHERE manager_id IS NULL)",
    "connected": "SELECT employee_id AS record FROM {employees} WHERE employee_id NOT IN"
    " (SELECT employee_id FROM {below_root})",
    "manager_active": "SELECT e.employee_id AS record FROM {employees} e LEFT JOIN {employees} m"
    " ON m.employee_id = e.manager_id WHERE e.status = 'left' AND coalesce(m.status, '') <> 'active'",
}))
def dq_tree(spark, sf):
    return quality.manager_tree(catalog(spark, sf))


@query("dq_status_dates", rows_sql({
    "dates_match_status": "SELECT employee_id AS record FROM {employees} WHERE (status = 'left') <> (left_date"
    " IS NOT NULL) OR left_date <= start_date",
    "successor_only_for_leavers": "SELECT employee_id AS record FROM {employees} WHERE (status <> 'left' AND"
    " successor_id IS NOT NULL) OR successor_id = employee_id",
    "successor_starts_in_time": "SELECT e.employee_id AS record FROM {employees} e JOIN {employees} s"
    " ON s.employee_id = e.successor_id WHERE s.start_date > e.left_date + 60",
}))
def dq_status_dates(spark, sf):
    return quality.status_dates(catalog(spark, sf))


@query("days_between_rules", """
SELECT e.employee_id, datediff('day', e.left_date, s.start_date)::BIGINT AS gap_days,
  least(greatest(s.start_date, e.start_date), e.left_date + 60) AS clamped
FROM {employees} e JOIN {employees} s ON s.employee_id = e.successor_id""")
def days_between_rules(spark, sf):
    from quarrylight.functions.scalars import clamp_date

    people = catalog(spark, sf).employees
    starts = people.select(F.col("employee_id").alias("successor_id"), F.col("start_date").alias("s"))
    return people.join(starts, "successor_id").select(
        "employee_id", F.datediff("s", "left_date").cast("bigint").alias("gap_days"),
        clamp_date(F.col("s"), F.col("start_date"), F.date_add("left_date", 60)).alias("clamped"),
    )


@query("dq_structures", rows_sql({
    "members_left": "SELECT m AS record FROM (SELECT unnest(chain) AS m FROM {chains}) x JOIN {employees} e"
    " ON e.employee_id = m WHERE e.status <> 'left'",
    "linked": "SELECT head AS record FROM {chains} c JOIN {employees} e ON e.employee_id = c.head"
    " WHERE len(chain) = 2 AND e.successor_id IS DISTINCT FROM chain[2]",
    "walk_matches_length": "SELECT head AS record FROM {chains} c JOIN {contacts} w ON w.employee_id = c.head"
    " WHERE w.hops <> len(chain) OR NOT w.resolved",
    "one_chain_each": "SELECT m AS record FROM (SELECT unnest(chain) AS m FROM {chains}) x GROUP BY 1"
    " HAVING count(*) > 1",
    "leavers_covered": "SELECT employee_id AS record FROM {employees} WHERE status = 'left' AND employee_id"
    " NOT IN (SELECT unnest(chain) FROM {chains})",
}))
def dq_structures(spark, sf):
    return quality.structures(catalog(spark, sf), chains(spark, sf))


@query("dq_one_head", rows_sql({
    "one_head": "SELECT department AS record FROM {employees} GROUP BY 1 HAVING sum(is_department_head::INT) <> 1",
    "head_active": "SELECT employee_id AS record FROM {employees} WHERE is_department_head AND status <> 'active'",
    "head_reports_to_root": "SELECT employee_id AS record FROM {employees} WHERE is_department_head AND"
    " employee_id <> 'EMP-0000' AND manager_id IS DISTINCT FROM 'EMP-0000'",
}))
def dq_one_head(spark, sf):
    return quality.one_head(catalog(spark, sf))


@query("dq_min_owned", rows_sql({
    "owns_enough": "SELECT c.head AS record FROM {chains} c WHERE (SELECT count(*) FROM {reports} r"
    " WHERE r.owner_id = c.head AND r.status = 'active') < len(c.chain) * 3"}))
def dq_min_owned(spark, sf):
    starters = chains(spark, sf).select(
        F.col("chain")[0].alias("employee_id"), (F.size("chain") * 3).alias("minimum")
    )
    return quality.min_owned(catalog(spark, sf), starters)


view("edge_layers", """
  SELECT e.*, p.layer AS pl, c.layer AS cl FROM {tedges} e JOIN {tables} p ON p.table_id = e.parent_table_id
    JOIN {tables} c ON c.table_id = e.child_table_id""")


@query("dq_layers", rows_sql({
    "name_shape": "SELECT table_id AS record FROM {tables} WHERE NOT regexp_full_match(name, '(stg|int|fct|dim)_[a-z0-9_]+')",
    "prefix_matches_layer": "SELECT table_id AS record FROM {tables} WHERE NOT ((layer = 'staging' AND name LIKE 'stg%')"
    " OR (layer = 'intermediate' AND name LIKE 'int%') OR (layer = 'mart' AND (name LIKE 'dim%' OR name LIKE 'fct%')))",
    "names_unique": "SELECT name AS record FROM {tables} GROUP BY 1 HAVING count(*) > 1",
    "edge_direction": "SELECT parent_table_id || ' ' || child_table_id AS record FROM {edge_layers} WHERE NOT"
    " ((pl = 'staging' AND cl IN ('intermediate', 'mart')) OR (pl = 'intermediate' AND cl = 'mart')"
    " OR (pl = 'intermediate' AND cl = 'intermediate' AND parent_table_id < child_table_id))",
    "required_marts": "SELECT n AS record FROM (SELECT unnest(['dim_calendar', 'fct_orders']) AS n) x"
    " WHERE n NOT IN (SELECT name FROM {tables} WHERE layer = 'mart')",
}) + share_sql("skip_share", "SELECT avg((pl = 'staging' AND cl = 'mart')::INT) AS value FROM {edge_layers}", 0.0, 0.1))
def dq_layers(spark, sf):
    return rounded(quality.layers(catalog(spark, sf), ["dim_calendar", "fct_orders"]))


@query("dq_cardinality", rows_sql({
    "tables_per_report": "SELECT r.report_id AS record FROM {reports} r LEFT JOIN (SELECT report_id, count(*) AS n"
    " FROM {redges} GROUP BY 1) e USING (report_id) WHERE coalesce(n, 0) NOT BETWEEN 1 AND 5",
    "no_staging": "SELECT e.report_id || ' ' || e.table_id AS record FROM {redges} e JOIN {tables} t USING (table_id)"
    " WHERE t.layer = 'staging'",
    "has_parent": "SELECT table_id AS record FROM {tables} WHERE layer <> 'staging' AND table_id NOT IN"
    " (SELECT child_table_id FROM {tedges})",
}) + share_sql("mart_share", "SELECT avg((t.layer = 'mart')::INT) AS value FROM {redges} e JOIN {tables} t USING (table_id)", 0.9, 1.0)
  + share_sql("staging_used_share", "SELECT avg((table_id IN (SELECT parent_table_id FROM {tedges}))::INT) AS value"
              " FROM {tables} WHERE layer = 'staging'", 0.9, 1.0))
def dq_cardinality(spark, sf):
    return rounded(quality.cardinality(catalog(spark, sf)))


@query("dq_metric_sources", rows_sql({
    "source_count": "SELECT metric_id AS record FROM {metrics} WHERE len(sources) NOT BETWEEN 1 AND 3",
    "mart_sources": "SELECT metric_id || ' ' || table_id AS record FROM {medges} JOIN {tables} USING (table_id)"
    " WHERE layer <> 'mart'",
    "has_alias": "SELECT metric_id AS record FROM {metrics} WHERE aliases = ''",
    "no_formula": "SELECT metric_id AS record FROM {metrics} WHERE formula IS NULL",
}))
def dq_metric_sources(spark, sf):
    return quality.metric_rules(catalog(spark, sf))


def _tenure_sql(table: str, key: str, person: str) -> str:
    return (
        f"SELECT t.{key} AS record FROM {{{table}}} t JOIN {{employees}} e ON e.employee_id = t.{person}"
        " WHERE t.created_date < e.start_date OR (e.status = 'left' AND t.created_date >= e.left_date)"
    )


@query("owner_tenure_check", _tenure_sql("reports", "report_id", "owner_id").replace("AS record", "AS report_id"))
def owner_tenure_check(spark, sf):
    cat = catalog(spark, sf)
    return quality.tenure(cat.reports, cat.employees, "owner_id", "created_date").select("report_id")


_ORDER = ("SELECT request_id AS record FROM (SELECT request_id, created_date, lag(created_date) OVER (ORDER BY k)"
          " AS before FROM {requests}) y WHERE created_date < before")


@query("ids_in_creation_order", _ORDER)
def ids_in_creation_order(spark, sf):
    return quality.out_of_order(catalog(spark, sf).requests, "request_id", "created_date", block=64)


@query("dq_temporal", rows_sql({
    "owner_employed": _tenure_sql("reports", "report_id", "owner_id"),
    "refresh_after_creation": f"SELECT report_id AS record FROM {{reports}} WHERE last_refresh < created_date"
    f" OR last_refresh > DATE '{TODAY}'",
    "closing_matches_status": f"SELECT request_id AS record FROM {{requests}} WHERE CASE WHEN status IN ('open', 'in_progress')"
    f" THEN closed_date IS NOT NULL ELSE closed_date IS NULL OR closed_date < created_date OR closed_date > DATE '{TODAY}' END",
    "result_after_request": "SELECT q.request_id AS record FROM {requests} q JOIN {reports} r"
    " ON r.report_id = q.resulting_report_id WHERE r.created_date < q.created_date",
    "ids_in_creation_order": _ORDER,
}))
def dq_temporal(spark, sf):
    return quality.temporal(catalog(spark, sf), TODAY)


@query("dq_replacements", rows_sql({
    "replaced_iff_deprecated": "SELECT report_id AS record FROM {reports} WHERE (replaced_by_report_id IS NOT NULL)"
    " <> (status = 'deprecated')",
    "replacement_active": "SELECT a.report_id AS record FROM {reports} a JOIN {reports} b ON b.report_id ="
    " a.replaced_by_report_id WHERE b.status <> 'active' OR b.replaced_by_report_id IS NOT NULL",
    "shares_a_table": "SELECT report_id AS record FROM {reports} WHERE replaced_by_report_id IS NOT NULL AND report_id NOT IN"
    " (SELECT r.report_id FROM {reports} r JOIN {redges} a ON a.report_id = r.report_id JOIN {redges} b"
    " ON b.report_id = r.replaced_by_report_id AND b.table_id = a.table_id)",
    "refresh_disabled": "SELECT report_id AS record FROM {reports} WHERE status = 'deprecated' AND refresh_status <> 'disabled'",
}))
def dq_replacements(spark, sf):
    return quality.replacements(catalog(spark, sf))


_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"


def jaccard_sql(a: str, b: str) -> str:
    return (f"len(list_intersect({a}, {b}))::DOUBLE / nullif(len({a}) + len({b})"
            f" - len(list_intersect({a}, {b})), 0)")


view("pair_names", """
  SELECT d.a, d.b, x.name AS name_a, y.name AS name_b,
    %s AS similarity FROM {designed} d JOIN {reports} x ON x.report_id = d.a JOIN {reports} y ON y.report_id = d.b
  """ % jaccard_sql(_WORDS.format("x.name"), _WORDS.format("y.name")))


@query("pair_jaccard", "SELECT a, b, round(similarity, 6) AS similarity FROM {pair_names}")
def pair_jaccard(spark, sf):
    found = quality.pair_similarity(catalog(spark, sf), designed_pairs(spark, sf))
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("dq_near_duplicates", rows_sql({
    "pairs_disjoint": "SELECT r AS record FROM (SELECT unnest([a, b]) AS r FROM {designed}) x GROUP BY 1 HAVING count(*) > 1",
    "similar_enough": "SELECT a || ' ' || b AS record FROM {pair_names} WHERE similarity < 0.5",
    "names_differ": "SELECT a || ' ' || b AS record FROM {pair_names} WHERE name_a = name_b",
    "no_region_clash": "SELECT report_id AS record FROM {traits} WHERE variant = 'regional' AND subject IN"
    " (SELECT subject FROM {traits} WHERE qualifier = 'region')",
}))
def dq_near_duplicates(spark, sf):
    return quality.near_duplicates(catalog(spark, sf), designed_pairs(spark, sf), traits(spark, sf))


_MIX = rows_sql({
    "duplicate_points": "SELECT request_id AS record FROM {requests} WHERE (duplicate_of_request_id IS NOT NULL)"
    " <> (status = 'duplicate')",
    "earlier_same_topic": "SELECT q.request_id AS record FROM {requests} q JOIN {requests} o ON o.request_id ="
    " q.duplicate_of_request_id JOIN {topics} a ON a.request_id = q.request_id JOIN {topics} b"
    " ON b.request_id = o.request_id WHERE NOT o.created_date < q.created_date OR a.topic_key <> b.topic_key",
    "result_only_when_done": "SELECT request_id AS record FROM {requests} WHERE resulting_report_id IS NOT NULL"
    " AND status <> 'done'",
})
for _status, _share in quality.STATUS_SHARES.items():
    _MIX += share_sql(f"share_{_status}", f"SELECT avg((status = '{_status}')::INT) AS value FROM {{requests}}",
                      _share - 0.03, _share + 0.03)
_MIX += share_sql("done_with_result", "SELECT avg((resulting_report_id IS NOT NULL)::INT) AS value FROM {requests}"
                  " WHERE status = 'done'", 0.7, 0.8)


@query("dq_status_mix", _MIX)
def dq_status_mix(spark, sf):
    return rounded(quality.status_mix(catalog(spark, sf), topics(spark, sf)))


_NAMES = ("SELECT report_id AS record, name AS text FROM {reports} UNION ALL SELECT table_id, name FROM {tables}"
          " UNION ALL SELECT metric_id, name FROM {metrics}")
_TEXTS = ("SELECT request_id AS record, title || ' ' || description AS text FROM {requests}"
          " UNION ALL SELECT report_id, name || ' ' || description FROM {reports}")


@query("dq_reserved_terms", rows_sql(
    {f"fragment:{t}": f"SELECT record FROM ({_NAMES}) n WHERE contains(lower(text), '{t}')" for t in FRAGMENTS}
    | {f"keyword:{t}": f"SELECT record FROM ({_TEXTS}) n WHERE contains(lower(text), '{t}')" for t in KEYWORDS}))
def dq_reserved_terms(spark, sf):
    return quality.reserved_terms(catalog(spark, sf), FRAGMENTS, KEYWORDS)


@query("dq_noise", rows_sql({
    "abbreviation_tag": "SELECT report_id AS record FROM {reports} WHERE list_has_any(string_split(tags, '|'),"
    " ['urgent', 'machinery'])",
    "vague_description": "SELECT report_id AS record FROM {reports} WHERE k % 10 = 7 AND len(list_intersect("
    + word_set_sql("name") + ", " + word_set_sql("description") + ")) > 0",
    "topic_size": "SELECT topic_key AS record FROM {topics} GROUP BY 1 HAVING count(*) NOT BETWEEN 2 AND 8",
    "no_formula": "SELECT metric_id AS record FROM {metrics} WHERE formula IS NULL",
}) + share_sql("failed_share", "SELECT avg((refresh_status = 'failed')::INT) AS value FROM {reports}"
               " WHERE status = 'active'", 0.06, 0.1))
def dq_noise(spark, sf):
    return rounded(quality.noise(catalog(spark, sf), vague(spark, sf), topics(spark, sf), ABBREVIATIONS))


def _sentences_sql(text: str) -> str:
    # An end mark, then white space: cut there; blank pieces do not count.
    return (f"len(list_filter(string_split_regex(regexp_replace(trim({text}, ' '), '([.!?])\\s+',"
            f" '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''))")


@query("sentence_count", f"SELECT doc_id, {_sentences_sql('text')}::BIGINT AS sentences FROM documents")
def sentence_count(spark, sf):
    from quarrylight.functions.text import sentence_count as count_sentences

    return source(spark, sf, "documents").select(
        "doc_id", count_sentences(F.col("text")).cast("bigint").alias("sentences")
    )


@query("dq_realism", rows_sql({
    "report_names_unique": "SELECT name AS record FROM {reports} GROUP BY 1 HAVING count(*) > 1",
    "tag_count": "SELECT report_id AS record FROM {reports} WHERE len(string_split(tags, '|')) NOT BETWEEN 1 AND 5",
    "report_sentences": f"SELECT report_id AS record FROM {{reports}} WHERE {_sentences_sql('description')} NOT BETWEEN 1 AND 3",
    "request_sentences": f"SELECT request_id AS record FROM {{requests}} WHERE {_sentences_sql('description')} NOT BETWEEN 1 AND 3",
    "column_json": "SELECT table_id AS record FROM {tables} WHERE NOT json_valid(columns_json)",
    "requester_employed": _tenure_sql("requests", "request_id", "requester_id"),
    "assignee_employed": _tenure_sql("requests", "request_id", "assignee_id"),
    "two_people": "SELECT request_id AS record FROM {requests} WHERE requester_id = assignee_id",
    "requester_department": "SELECT request_id AS record FROM {requests} q LEFT JOIN {employees} e"
    " ON e.employee_id = q.requester_id WHERE q.department IS DISTINCT FROM e.department",
    "titles_vary": "SELECT topic_key AS record FROM {topics} JOIN {requests} USING (request_id) GROUP BY 1"
    " HAVING count(*) > 1 AND count(DISTINCT title) = 1",
}) + share_sql("department_matches_owner", "SELECT avg((r.department = e.department)::INT) AS value FROM {reports} r"
               " JOIN {employees} e ON e.employee_id = r.owner_id", 0.78, 0.92)
  + share_sql("unused_share", "SELECT avg((usage_30d = 0)::INT) AS value FROM {reports} WHERE status = 'active'", 0.15, 0.25)
  + share_sql("tables_owned_by_data", "SELECT avg((e.department = 'MACHINERY')::INT) AS value FROM {tables} t"
              " JOIN {employees} e ON e.employee_id = t.owner_id", 0.7, 1.0)
  + share_sql("assigned_to_data", "SELECT avg((e.department = 'MACHINERY')::INT) AS value FROM {requests} t"
              " JOIN {employees} e ON e.employee_id = t.assignee_id", 0.8, 1.0))
def dq_realism(spark, sf):
    return rounded(quality.realism(catalog(spark, sf), topics(spark, sf), "MACHINERY"))


_DEPARTED = "\nUNION ALL ".join(
    f"SELECT '{t}' AS rule, CASE WHEN v BETWEEN {lo}::DOUBLE AND {hi}::DOUBLE THEN 0 ELSE 1 END::BIGINT AS violations,"
    f" NULL::VARCHAR AS sample, round(v, 6) AS value FROM (SELECT avg((e.status = 'left')::INT) AS v FROM {{{t}}} t"
    f" JOIN {{employees}} e ON e.employee_id = t.owner_id {where}) x"
    for t, where, lo, hi in (("reports", "WHERE t.status = 'active'", 0.0, 0.18), ("tables", "", 0.15, 0.2),
                             ("metrics", "", 0.15, 0.2)))


@query("dq_departed_share", _DEPARTED)
def dq_departed_share(spark, sf):
    return rounded(quality.departed_share(catalog(spark, sf)))


@query("departed_owner_share", f"SELECT rule AS kind, value AS departed_share FROM ({_DEPARTED}) y")
def departed_owner_share(spark, sf):
    return rounded(quality.departed_share(catalog(spark, sf))).select(
        F.col("rule").alias("kind"), F.col("value").alias("departed_share")
    )


_SETS = "list_sort(list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+')))"
view("name_sets", f"""
  SELECT words, array_to_string(words, ' ') AS key, count(*)::BIGINT AS copies, min(report_id) AS first_id,
    max(report_id) AS last_id FROM (SELECT report_id, {_SETS.format("name")} AS words FROM {{reports}}) x
  GROUP BY words""".replace("{{", "{").replace("}}", "}"))
# Names share word, segment and "view" freely; above 0.6 they must share a numbered word too.
view("similar_names", """
  SELECT a.key AS key_a, b.key AS key_b, %s AS similarity, a.copies AS copies_a, b.copies AS copies_b,
    a.first_id AS first_a, b.first_id AS first_b
  FROM (SELECT DISTINCT x.key AS ka, y.key AS kb FROM
      (SELECT key, unnest(words) AS w FROM {name_sets}) x JOIN (SELECT key, unnest(words) AS w FROM {name_sets}) y
      ON x.w = y.w AND x.key < y.key AND regexp_matches(x.w, '[0-9]')) c
  JOIN {name_sets} a ON a.key = c.ka JOIN {name_sets} b ON b.key = c.kb
  WHERE %s > 0.6""" % (jaccard_sql("a.words", "b.words"), jaccard_sql("a.words", "b.words")))


def report_names(spark, sf):
    return catalog(spark, sf).reports.select(F.col("report_id").alias("id"), "name")


@query("similar_name_pairs", "SELECT key_a, key_b, round(similarity, 6) AS similarity, copies_a, copies_b,"
       " first_a, first_b FROM {similar_names}")
def similar_name_pairs(spark, sf):
    return similarity.similar_name_pairs(report_names(spark, sf)).withColumn(
        "similarity", F.round("similarity", 6)
    )


view("look_reports", """
  SELECT a, b, similarity FROM (
    SELECT least(first_a, first_b) AS a, greatest(first_a, first_b) AS b, similarity FROM {similar_names}
    UNION ALL SELECT first_id, last_id, 1.0 FROM {name_sets} WHERE copies > 1) x
  WHERE (a, b) NOT IN (SELECT (a, b) FROM {designed}) AND (a, b) NOT IN
    (SELECT (least(report_id, replaced_by_report_id), greatest(report_id, replaced_by_report_id))
     FROM {reports} WHERE replaced_by_report_id IS NOT NULL)""")


@query("dq_lookalikes", "SELECT a, b, round(similarity, 6) AS similarity FROM {look_reports}")
def dq_lookalikes(spark, sf):
    designed = designed_pairs(spark, sf).union(deprecated_pairs(spark, sf))
    return similarity.lookalikes(report_names(spark, sf), designed).withColumn(
        "similarity", F.round("similarity", 6)
    )


def _opening_sql(sql: str) -> str:
    return (f"SELECT word, count(*)::BIGINT AS n, count(*) / sum(count(*)) OVER () AS share FROM (SELECT"
            f" regexp_extract(lower(t), '[a-z0-9]+') AS word FROM ({sql}) x) y WHERE word <> '' GROUP BY 1")


@query("top_share_opening_word", "SELECT word, n, round(share, 6) AS share FROM ("
       + _opening_sql("SELECT description AS t FROM {requests}") + ") z")
def top_share_opening_word(spark, sf):
    return quality.opening_words(catalog(spark, sf).requests, "description").withColumn(
        "share", F.round("share", 6)
    )


@query("dq_template_tics", rows_sql({
    f"{t}.{c}": f"SELECT word AS record FROM ({_opening_sql(f'SELECT {c} AS t FROM {{{t}}}')}) o WHERE share > 0.15"
    for t, c in (("reports", "description"), ("requests", "title"), ("requests", "description"))}))
def dq_template_tics(spark, sf):
    return quality.template_tics(catalog(spark, sf))


# ------------------------------------------------------------------ profiles


def _counts_sql(table: str, column: str) -> str:
    return (f"SELECT '{table}.{column}' AS field, {column} AS value, count(*)::BIGINT AS n, round(count(*) /"
            f" (SELECT count(*) FROM {{{table}}}), 6) AS share FROM {{{table}}} GROUP BY {column}")


@query("value_counts_share", "\nUNION ALL ".join(_counts_sql(t, c) for t, c in profile.COUNTED))
def value_counts_share(spark, sf):
    return profile.value_counts(catalog(spark, sf)).withColumn("share", F.round("share", 6))


@query("crosstab_dept_status", "SELECT department, count(*) FILTER (status = 'active')::BIGINT AS active,"
       " count(*) FILTER (status = 'left')::BIGINT AS \"left\" FROM {employees} GROUP BY 1")
def crosstab(spark, sf):
    return profile.department_status(catalog(spark, sf))


_USAGE = ", ".join(f"round(quantile_cont(usage_30d, {q}), 6) AS {n}" for n, q in profile.USAGE_QUANTILES.items())


@query("usage_quantiles", f"SELECT {_USAGE}, max(usage_30d)::BIGINT AS max_usage, round((SELECT avg((usage_30d = 0)::INT)"
       " FROM {reports} WHERE status = 'active'), 6) AS unused_share FROM {reports}")
def usage_quantiles(spark, sf):
    found = profile.usage_quantiles(catalog(spark, sf))
    return found.select(
        *[F.round(c, 6).alias(c) for c in (*profile.USAGE_QUANTILES, "unused_share")], "max_usage"
    )


@query("profile_tables", "\nUNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*)::BIGINT AS n FROM {{{v}}}" for name, v in (
        ("employees", "employees"), ("reports", "reports"), ("tables", "tables"), ("report_table_edges", "redges"),
        ("table_table_edges", "tedges"), ("metrics", "metrics"), ("requests", "requests"))))
def profile_tables(spark, sf):
    return profile.table_sizes(catalog(spark, sf))


@query("profile_structures", """
SELECT 'C' || len(chain) AS code, w.resolved, w.hops::BIGINT AS hops, count(*)::BIGINT AS chains,
  sum(len(chain))::BIGINT AS people FROM {chains} c JOIN {contacts} w ON w.employee_id = c.head GROUP BY ALL""")
def profile_structures(spark, sf):
    return profile.structure_table(catalog(spark, sf), chains(spark, sf))


@query("profile_noise", """
SELECT 'N1' AS code, (SELECT count(*) FROM {designed})::BIGINT AS n
UNION ALL SELECT 'N2', count(*) FROM {reports} WHERE status = 'deprecated'
UNION ALL SELECT 'N3', count(*) FROM {reports} WHERE list_has_any(string_split(tags, '|'), ['urgent', 'machinery'])
UNION ALL SELECT 'N4', count(*) FROM {reports} WHERE k % 10 = 7
UNION ALL SELECT 'N5', count(*) FROM {reports} WHERE status = 'active' AND refresh_status = 'failed'
UNION ALL SELECT 'N6', count(DISTINCT topic_key) FROM {topics}
UNION ALL SELECT 'N7', count(*) FROM {metrics} WHERE formula IS NULL""")
def profile_noise(spark, sf):
    return profile.noise_counts(
        catalog(spark, sf), designed_pairs(spark, sf), vague(spark, sf), topics(spark, sf), ABBREVIATIONS
    )


def _sample_sql(t: str, key: str, text: str) -> str:
    return (f"SELECT '{t}' AS table_name, {key} AS record, CASE WHEN length({text}) > 70 THEN substr({text}, 1, 69)"
            f" || '…' ELSE {text} END AS text FROM (SELECT *, row_number() OVER (ORDER BY k) - 1 AS i,"
            f" count(*) OVER () AS n FROM {{{t}}}) x WHERE i IN (0, n // 2, n - 1)")


_SAMPLES = [("employees", "employee_id", "full_name"), ("reports", "report_id", "name"),
            ("tables", "table_id", "name"), ("metrics", "metric_id", "name"), ("requests", "request_id", "title")]


@query("profile_samples", "\nUNION ALL ".join(_sample_sql(*s) for s in _SAMPLES))
def profile_samples(spark, sf):
    return profile.samples(catalog(spark, sf), _SAMPLES)


@query("sample_first_mid_last", "SELECT record FROM (" + _sample_sql("reports", "report_id", "name") + ") y")
def sample_first_mid_last(spark, sf):
    return profile.first_middle_last(catalog(spark, sf).reports, "report_id").select(
        F.col("report_id").alias("record")
    )


