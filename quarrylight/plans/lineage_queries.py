"""Queries over lineage, ownership and impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.operators import impact, lineage, ownership
from quarrylight.operators.reach_bitmaps import reach_bitmaps, reach_counts
from quarrylight.plans.bindings import catalog
from quarrylight.plans.registry import query
from quarrylight.sources.catalog import assets


def _number(column: str):
    return F.split(F.col(column), "-")[1].cast("bigint")


def _requests(df, column: str, depths: int):
    """One request per record; the asked depth cycles through 1..depths."""
    return df.select(
        F.col(column).alias("seed"), (_number(column) % depths + 1).cast("int").alias("depth")
    )


def _all_requests(cat, depths: int):
    return (
        _requests(cat.tables, "table_id", depths)
        .union(_requests(cat.reports, "report_id", depths))
        .union(_requests(cat.metrics, "metric_id", depths))
    )


@query("union_assets", "SELECT * FROM {assets}")
def union_assets(spark, sf):
    return assets(catalog(spark, sf))


@query("lineage_nodes", "SELECT asset_id AS id, type, name, layer, status FROM {assets}")
def lineage_nodes(spark, sf):
    return lineage.lineage_nodes(catalog(spark, sf))


@query("lineage_edges", "SELECT src, dst, kind FROM {edges}")
def lineage_edges(spark, sf):
    return lineage.lineage_edges(catalog(spark, sf))


@query("union_edges", "SELECT kind, count(*)::BIGINT AS edges, min(src) AS first_src,"
       " max(dst) AS last_dst FROM {edges} GROUP BY kind")
def union_edges(spark, sf):
    return lineage.lineage_edges(catalog(spark, sf)).groupBy("kind").agg(
        F.count("*").alias("edges"), F.min("src").alias("first_src"), F.max("dst").alias("last_dst")
    )


@query("neighbor_counts", """
SELECT t.table_id,
  (SELECT count(*) FROM {tedges} e WHERE e.child_table_id = t.table_id)::BIGINT AS parent_table_count,
  (SELECT count(*) FROM {tedges} e WHERE e.parent_table_id = t.table_id)::BIGINT AS child_table_count
FROM {tables} t""")
def neighbor_counts(spark, sf):
    return lineage.neighbor_counts(catalog(spark, sf))


@query("descendants", "SELECT seed, node FROM {treach}")
def descendants(spark, sf):
    return lineage.table_closure(catalog(spark, sf))


@query("ancestors", """
SELECT r.report_id AS seed, count(*)::BIGINT AS ancestors, min(t.seed) AS first_id,
  max(t.seed) AS last_id
FROM {reports} r JOIN (SELECT DISTINCT e.report_id, t.seed FROM {redges} e
  JOIN {treach0} t ON t.node = e.table_id) t USING (report_id) GROUP BY 1""")
def ancestors(spark, sf):
    cat = catalog(spark, sf)
    reports = cat.reports.select(F.col("report_id").alias("seed"))
    counts = reach_counts(_bitmaps(cat, "upstream")).join(reports, "seed", "left_semi")
    return counts.select("seed", F.col("n").alias("ancestors"), "first_id", "last_id")


def _bitmaps(cat, direction):
    """What every asset reaches, prepared once per session; the kind of a node is its type."""
    key = f"bitmaps_{direction}"
    if key not in cat.prepared:
        edges = lineage.lineage_edges(cat).select("src", "dst")
        kinds = lineage.lineage_nodes(cat).select("id", F.col("type").alias("kind"))
        cat.prepared[key] = reach_bitmaps(
            lineage.reversed_edges(edges) if direction == "upstream" else edges, kinds, counts_only=True
        )
    return cat.prepared[key]


@query("impact_sizes", """
SELECT seed AS table_id, type, count(*)::BIGINT AS assets, min(id) AS first_id, max(id) AS last_id
FROM (SELECT seed, 'table' AS type, node AS id FROM {treach}
  UNION ALL SELECT seed, 'report', report_id FROM {ireports}
  UNION ALL SELECT seed, 'metric', metric_id FROM {imetrics}) x GROUP BY ALL""")
def impact_sizes(spark, sf):
    """How much a change of each table affects, by type: counted without a pair table."""
    return reach_counts(_bitmaps(catalog(spark, sf), "downstream")).select(
        F.col("seed").alias("table_id"), F.col("kind").alias("type"), F.col("n").alias("assets"), "first_id", "last_id"
    )


_BFS = """
SELECT seed, depth::BIGINT AS depth, {end} AS node, min(distance)::BIGINT AS distance FROM (
  WITH RECURSIVE b(seed, depth, {end}, distance) AS (
    SELECT s.id, s.depth, e.{end}, 1 FROM (SELECT asset_id AS id,
        (split_part(asset_id, '-', 2)::BIGINT % 6 + 1) AS depth FROM {assets}) s
      JOIN {edges} e ON e.{begin} = s.id
    UNION SELECT b.seed, b.depth, e.{end}, b.distance + 1 FROM b
      JOIN {edges} e ON e.{begin} = b.{end} WHERE b.distance < b.depth)
  SELECT * FROM b) x GROUP BY ALL"""
_DOWN = _BFS.replace("{end}", "dst").replace("{begin}", "src")
_UP = _BFS.replace("{end}", "src").replace("{begin}", "dst")
_BFS_SUMMARY = """
SELECT depth, distance, count(*)::BIGINT AS pairs, count(DISTINCT seed)::BIGINT AS seeds,
  count(DISTINCT node)::BIGINT AS nodes FROM ({body}) y GROUP BY ALL"""


def _bfs_summary(spark, sf, direction):
    cat = catalog(spark, sf)
    found = lineage.bfs(cat, _all_requests(cat, 6), direction).withColumns(
        {"depth": F.col("depth").cast("bigint"), "distance": F.col("distance").cast("bigint")}
    )
    by = ["depth", "distance"]
    # Counted per end first, so that no pair is copied for every kind of count.
    seeds = found.groupBy(*by, "seed").agg(F.count("*").alias("n")).groupBy(*by).agg(
        F.sum("n").alias("pairs"), F.count("seed").alias("seeds")
    )
    nodes = found.select(*by, "node").distinct().groupBy(*by).agg(F.count("node").alias("nodes"))
    return seeds.join(nodes, by).select(*by, "pairs", "seeds", "nodes")


@query("bfs_downstream", _BFS_SUMMARY.replace("{body}", _DOWN))
def bfs_downstream(spark, sf):
    return _bfs_summary(spark, sf, "downstream")


@query("bfs_upstream", _BFS_SUMMARY.replace("{body}", _UP))
def bfs_upstream(spark, sf):
    return _bfs_summary(spark, sf, "upstream")


@query("lineage_top100", f"""
SELECT seed, node, distance, rank FROM (
  SELECT seed, node, distance, row_number() OVER (PARTITION BY seed ORDER BY distance, node)::BIGINT
    AS rank FROM ({_DOWN}) d) r WHERE rank <= 100 AND seed LIKE 'TBL-%'""")
def lineage_top100(spark, sf):
    cat = catalog(spark, sf)
    found = lineage.bfs(cat, _requests(cat.tables, "table_id", 6), "downstream")
    return lineage.top_nodes(found).select(
        "seed", "node", F.col("distance").cast("bigint"), F.col("rank").cast("bigint")
    )


@query("trace_lineage", f"""
SELECT t.seed, t.depth, t.node, a.type, a.name, t.distance, t.rank,
  f.reachable > count(*) OVER (PARTITION BY t.seed) AS truncated
FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY distance, node)::BIGINT AS rank
    FROM ({_UP}) u) t
JOIN {{assets}} a ON a.asset_id = t.node
JOIN (SELECT seed, count(DISTINCT node) AS reachable FROM (
    SELECT node AS seed, seed AS node FROM {{treach}}
    UNION ALL SELECT e.report_id, r.seed FROM {{redges}} e JOIN {{treach0}} r ON r.node = e.table_id
    UNION ALL SELECT e.metric_id, r.seed FROM {{medges}} e JOIN {{treach0}} r ON r.node = e.table_id
  ) z GROUP BY 1) f ON f.seed = t.seed
WHERE t.rank <= 100""".replace("{{", "{").replace("}}", "}"))
def trace_lineage(spark, sf):
    cat = catalog(spark, sf)
    traced = lineage.trace_lineage(cat, _all_requests(cat, 6), "upstream")
    return traced.select(
        "seed", F.col("depth").cast("bigint"), "node", "type", "name",
        F.col("distance").cast("bigint"), F.col("rank").cast("bigint"), "truncated",
    )


@query("check_dag", """
SELECT count(*) = 0 AS is_dag, 0::BIGINT AS cyclic_edges, 0::BIGINT AS cycle_length, NULL::VARCHAR AS witness
FROM {treach} WHERE seed = node""")
def check_dag(spark, sf):
    return lineage.check_dag(lineage.lineage_edges(catalog(spark, sf)))


@query("upstream_tables", f"""
SELECT depth, seed, count(*)::BIGINT AS tables, min(node) AS first_id, max(node) AS last_id
FROM ({_UP}) u GROUP BY ALL""")
def upstream_tables(spark, sf):
    cat = catalog(spark, sf)
    found = lineage.upstream_tables(cat, _all_requests(cat, 6))
    return found.groupBy(F.col("depth").cast("bigint").alias("depth"), "seed").agg(
        F.count("*").alias("tables"), F.min("node").alias("first_id"), F.max("node").alias("last_id")
    )


@query("downstream_reports", f"""
SELECT depth, seed, count(*)::BIGINT AS reports, min(node) AS first_id, max(node) AS last_id
FROM ({_DOWN}) u WHERE seed LIKE 'TBL-%' AND node LIKE 'RPT-%' GROUP BY ALL""")
def downstream_reports(spark, sf):
    cat = catalog(spark, sf)
    found = lineage.downstream_reports(cat, _requests(cat.tables, "table_id", 6))
    return found.groupBy(F.col("depth").cast("bigint").alias("depth"), "seed").agg(
        F.count("*").alias("reports"), F.min("report_id").alias("first_id"),
        F.max("report_id").alias("last_id"),
    )


@query("dept_head", "SELECT department, head_id FROM {heads}")
def dept_head(spark, sf):
    return ownership.department_heads(catalog(spark, sf))


@query("asset_owner", "SELECT asset_id, owner_id FROM {assets}")
def asset_owner(spark, sf):
    return assets(catalog(spark, sf)).select("asset_id", "owner_id")


@query("asset_department", """
SELECT report_id AS asset_id, department FROM {reports}
UNION ALL SELECT t.table_id, e.department FROM {tables} t LEFT JOIN {employees} e
  ON e.employee_id = t.owner_id
UNION ALL SELECT m.metric_id, e.department FROM {metrics} m LEFT JOIN {employees} e
  ON e.employee_id = m.owner_id""")
def asset_department(spark, sf):
    cat = catalog(spark, sf)
    owners = cat.employees.select(F.col("employee_id").alias("owner_id"), "department")
    owned = cat.tables.selectExpr("table_id AS asset_id", "owner_id").union(
        cat.metrics.selectExpr("metric_id AS asset_id", "owner_id")
    )
    return cat.reports.selectExpr("report_id AS asset_id", "department").union(
        owned.join(owners, "owner_id", "left").select("asset_id", "department")
    )


@query("tables_of_report", """
SELECT r.report_id, r.name, e.table_id FROM {reports} r JOIN {redges} e USING (report_id)""")
def tables_of_report(spark, sf):
    # Rows, not lists: a report may read any number of tables.
    cat = catalog(spark, sf)
    return cat.reports.select("report_id", "name").join(cat.report_table_edges.distinct(), "report_id")


@query("resolve_owner", """
SELECT a.asset_id, a.owner_id AS original_owner_id, c.resolved, c.resolved_owner_id,
  c.hops::BIGINT AS hops, array_to_string(c.path, '>') AS path, c.fallback_contact_id, c.reason
FROM {assets} a JOIN {contacts} c ON c.employee_id = a.owner_id""")
def resolve_owner(spark, sf):
    return ownership.resolve_owner(catalog(spark, sf)).select(
        "asset_id", "original_owner_id", "resolved", "resolved_owner_id",
        F.col("hops").cast("bigint").alias("hops"),
        F.array_join(F.transform("path", lambda p: p["employee_id"]), ">").alias("path"),
        "fallback_contact_id", "reason",
    )


@query("current_contact", """
SELECT a.asset_id, c.contact_id, c.resolved FROM {assets} a
JOIN {contacts} c ON c.employee_id = a.owner_id""")
def current_contact(spark, sf):
    cat = catalog(spark, sf)
    people = ownership.contacts(cat).selectExpr("employee_id AS owner_id", "contact_id", "resolved")
    return assets(cat).select("asset_id", "owner_id").join(people, "owner_id").drop("owner_id")


@query("succession_structures", """
SELECT reason, hops::BIGINT AS hops, coalesce(vias, '') AS vias, count(*)::BIGINT AS people
FROM (SELECT c.employee_id, c.reason, c.hops,
    (SELECT string_agg(w.via, '>' ORDER BY w.hops) FROM {walks} w
      WHERE w.owner = c.employee_id AND w.hops < c.hops) AS vias
  FROM {contacts} c WHERE c.status = 'left') s GROUP BY ALL""")
def succession_structures(spark, sf):
    return ownership.succession_structures(catalog(spark, sf))


@query("impact_closure", """
SELECT seed AS table_id, type, count(*)::BIGINT AS assets, min(id) AS first_id, max(id) AS last_id,
  sum(split_part(id, '-', 2)::BIGINT)::BIGINT AS id_sum
FROM (SELECT seed, 'table' AS type, node AS id FROM {treach}
  UNION ALL SELECT seed, 'report', report_id FROM {ireports}
  UNION ALL SELECT seed, 'metric', metric_id FROM {imetrics}) x GROUP BY ALL""")
def impact_closure(spark, sf):
    return impact.impact_closure(catalog(spark, sf)).groupBy("table_id", "type").agg(
        F.count("*").alias("assets"), F.min("asset_id").alias("first_id"),
        F.max("asset_id").alias("last_id"), F.sum(_number("asset_id")).alias("id_sum"),
    )


@query("impact_contacts", """
SELECT table_id, employee_id, report_count, metric_count, total_usage_30d, via_fallback
FROM {inotify}""")
def impact_contacts(spark, sf):
    return impact.impact_contacts(catalog(spark, sf)).drop("id_chars")


@query("notify_ranked", """
SELECT table_id, employee_id, total_usage_30d, rank::BIGINT AS rank FROM {inotify_ranked}
WHERE rank <= 20""")
def notify_ranked(spark, sf):
    return impact.notify_ranked(catalog(spark, sf)).select(
        "table_id", "employee_id", "total_usage_30d", F.col("rank").cast("bigint")
    )


@query("broadcast_top10", """
SELECT table_id, employee_id, rank::BIGINT AS rank,
  CASE WHEN people > 20 THEN 'broadcast' ELSE 'individual' END AS notify_mode,
  CASE WHEN people > 20 THEN people - 10 ELSE 0 END::BIGINT AS notify_omitted_count
FROM {inotify_list}""")
def broadcast_top10(spark, sf):
    return impact.notify_list(catalog(spark, sf)).select(
        "table_id", "employee_id", F.col("rank").cast("bigint"), "notify_mode",
        "notify_omitted_count",
    )


@query("impact_rollup", """
SELECT table_id, department, head_employee_id, people_count, report_count,
  row_number() OVER (PARTITION BY table_id ORDER BY people_count DESC, department)::BIGINT AS rank
FROM {irollup}""")
def impact_rollup(spark, sf):
    return impact.impact_rollup(catalog(spark, sf))


_SHOWN = """
  string_agg(asset_id, ',' ORDER BY rn) FILTER (cut_order = 1) AS affected_reports,
  string_agg(asset_id, ',' ORDER BY rn) FILTER (cut_order = 2) AS affected_tables,
  string_agg(asset_id, ',' ORDER BY rn) FILTER (cut_order = 3) AS affected_metrics,
  string_agg(asset_id, ',' ORDER BY rn) FILTER (cut_order = 4) AS unresolved_asset_ids"""


@query("impact_analysis", f"""
SELECT s.table_id, notify_mode, notify_total_count, notify_omitted_count, affected_report_count,
  affected_metric_count, coalesce(affected_reports, '') AS affected_reports,
  coalesce(affected_tables, '') AS affected_tables,
  coalesce(affected_metrics, '') AS affected_metrics,
  coalesce(unresolved_asset_ids, '') AS unresolved_asset_ids,
  coalesce(n, 0) < affected_report_count + affected_metric_count + affected_table_count
    + unresolved_count AS truncated
FROM {{isummary}} s LEFT JOIN (SELECT table_id, count(*) AS n, {_SHOWN}
  FROM {{ishown}} GROUP BY 1) i USING (table_id)""".replace("{{", "{").replace("}}", "}"))
def impact_analysis(spark, sf):
    lists = ["affected_reports", "affected_tables", "affected_metrics", "unresolved_asset_ids"]
    answer = impact.impact_analysis(catalog(spark, sf))
    return answer.withColumns({name: F.array_join(name, ",") for name in lists})


@query("fit_to_limit", """
SELECT table_id, cut_order::BIGINT AS cut_order, count(*)::BIGINT AS kept, max(rn)::BIGINT AS last_rank,
  bool_or(cut) AS truncated FROM {ishown} GROUP BY ALL""")
def fit_to_limit(spark, sf):
    return impact.impact_shown(catalog(spark, sf)).groupBy(
        "table_id", F.col("cut_order").cast("bigint").alias("cut_order")
    ).agg(
        F.count("*").alias("kept"), F.max("rank").cast("bigint").alias("last_rank"),
        F.bool_or("truncated").alias("truncated"),
    )


_FANOUT = """
SELECT s.table_id, t.name, t.layer, notify_mode, notify_total_count, affected_report_count,
  affected_metric_count, (base_chars + coalesce(chars, 0)
    - CASE WHEN coalesce(cut, false) THEN 1 ELSE 0 END)::BIGINT AS payload_chars,
  coalesce(cut, false) AS truncated
FROM {isummary} s JOIN {tables} t USING (table_id) JOIN {ibase} b USING (table_id)
LEFT JOIN (SELECT table_id, sum(chars + CASE WHEN rn > 1 THEN 1 ELSE 0 END) AS chars,
  bool_or(cut) AS cut FROM {ishown} GROUP BY 1) i USING (table_id)"""


@query("impact_fanout", _FANOUT)
def impact_fanout(spark, sf):
    return impact.impact_fanout(catalog(spark, sf))


@query("fanout_summary", f"""
SELECT coalesce(layer, 'all') AS layer, count(*) FILTER (notify_mode = 'individual')::BIGINT
  AS individual, count(*) FILTER (notify_mode = 'broadcast')::BIGINT AS broadcast,
  max(payload_chars) AS max_payload_chars, count(*) FILTER (truncated)::BIGINT AS truncated_count
FROM ({_FANOUT}) f GROUP BY ROLLUP (layer)""")
def fanout_summary(spark, sf):
    return impact.fanout_summary(catalog(spark, sf))
