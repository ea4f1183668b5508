"""SQL views over the driver's tables, shared by the oracle queries.

Each view is written independently of the Spark code. `with_views` prepends the views a query
names, with the views those need, in dependency order.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


view("employees", """
  SELECT c.c_custkey AS k, printf('EMP-%04d', c.c_custkey) AS employee_id, c_name AS full_name,
    c_mktsegment AS department,
    CASE c.c_custkey % 4 WHEN 0 THEN 'Analyst' WHEN 1 THEN 'Engineer' WHEN 2 THEN 'Manager'
      ELSE 'Planner' END AS title,
    c.c_custkey = (SELECT min(h.c_custkey) FROM customer h WHERE h.c_mktsegment = c.c_mktsegment
      AND NOT (h.c_custkey % 3 = 0 AND h.c_custkey >= 5)) AS is_department_head,
    CASE WHEN c.c_custkey % 3 = 0 AND c.c_custkey >= 5 THEN 'left' ELSE 'active' END AS status,
    CASE WHEN c.c_custkey % 45 <> 0 THEN printf('EMP-%04d', c.c_custkey // 10) END AS manager_id,
    CASE WHEN NOT (c.c_custkey % 3 = 0 AND c.c_custkey >= 5) THEN NULL
      WHEN c.c_custkey % 66 = 33 AND c.c_custkey + 6 < (SELECT count(*) FROM customer)
        THEN printf('EMP-%04d', c.c_custkey + 6)
      WHEN c.c_custkey % 66 = 39 THEN printf('EMP-%04d', c.c_custkey - 6)
      WHEN c.c_custkey % 2 = 1
        THEN printf('EMP-%04d', (c.c_custkey * 7 + 3) % (SELECT count(*) FROM customer))
      END AS successor_id,
    (DATE '2010-01-01' + (c.c_custkey % 3000)::INT) AS start_date,
    CASE WHEN c.c_custkey % 3 = 0 AND c.c_custkey >= 5
      THEN DATE '2010-01-01' + (c.c_custkey % 3000 + 30 + c.c_custkey % 700)::INT END AS left_date
  FROM customer c""")
view("heads", "SELECT department, employee_id AS head_id FROM {employees} WHERE is_department_head")
view("reports", """
  SELECT k, printf('RPT-%04d', k) AS report_id,
    word || ' ' || lower(seg) || ' view x' || (k // 3) || ' y' || (k // 2) AS name,
    lower(seg) || ' workspace' AS workspace, printf('EMP-%04d', o_custkey) AS owner_id,
    seg AS department,
    'Order value ' || floor(o_totalprice)::BIGINT || ' by ' || lower(seg) || '.' AS description,
    day AS created_date, day + (k % 90)::INT AS last_refresh,
    CASE WHEN o_orderstatus = 'P' THEN 'disabled' WHEN k % 17 = 0 THEN 'failed' ELSE 'success' END
      AS refresh_status,
    word || '|' || lower(seg) AS tags, floor(o_totalprice)::BIGINT AS usage_30d,
    CASE WHEN o_orderstatus = 'P' THEN 'deprecated' ELSE 'active' END AS status,
    CASE WHEN o_orderstatus = 'P'
      THEN printf('RPT-%04d', (k + 1) % (SELECT count(*) FROM orders)) END AS replaced_by_report_id
  FROM (SELECT *, o_orderkey AS k, o_orderdate::DATE AS day, lower(substr(o_orderpriority, 3)) AS word,
    CASE o_orderkey % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE'
      WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END AS seg FROM orders) o""")
view("tables", """
  SELECT p_partkey AS k, printf('TBL-%04d', p_partkey) AS table_id,
    CASE p_partkey % 3 WHEN 0 THEN 'stg_' WHEN 1 THEN 'int_' ELSE 'dim_' END
      || replace(p_name, ' ', '_') || '_' || p_partkey AS name,
    CASE p_partkey % 3 WHEN 0 THEN 'staging' WHEN 1 THEN 'intermediate' ELSE 'mart' END AS layer,
    lower(p_type) AS source_system, 's_' || lower(replace(p_brand, '#', '')) AS schema_name,
    printf('EMP-%04d', (p_partkey * 13 + 5) % (SELECT count(*) FROM customer)) AS owner_id,
    p_name || ' of ' || p_brand || '.' AS description,
    CASE p_partkey % 4
      WHEN 0 THEN '[{"name":"order_id","type":"string"}]'
      WHEN 1 THEN '[{"name":"is_open","type":"boolean"},{"name":"ship_date","type":"date"}]'
      WHEN 2 THEN '[{"name":"part_key","type":"integer"},{"name":"unit_price","type":"decimal(18,2)"},{"name":"loaded_at","type":"timestamp"}]'
      ELSE '[{"name":"rating_score","type":"decimal(5,2)"},{"name":"labour_hours","type":"decimal(9,2)"}]'
      END AS columns_json,
    floor(p_retailprice * 100)::BIGINT AS row_count,
    CASE p_partkey % 4 WHEN 0 THEN 'hourly' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly'
      ELSE 'monthly' END AS update_frequency
  FROM part""")
view("tedges", """
  SELECT DISTINCT printf('TBL-%04d', parent) AS parent_table_id,
    printf('TBL-%04d', child) AS child_table_id,
    CASE (parent + child) % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'join' WHEN 2 THEN 'aggregate'
      ELSE 'snapshot' END AS transform_type
  FROM (SELECT p_partkey // 2 AS parent, p_partkey AS child FROM part WHERE p_partkey > 0
    UNION SELECT p_partkey // 3, p_partkey FROM part WHERE p_partkey > 0) e""")
view("redges", """
  SELECT DISTINCT printf('RPT-%04d', l_orderkey) AS report_id,
    printf('TBL-%04d', l_partkey) AS table_id FROM lineitem""")
view("metrics", """
  SELECT s_suppkey AS k, printf('MET-%04d', s_suppkey) AS metric_id,
    lower(replace(s_name, '#', ' ')) AS name,
    'S' || s_suppkey || '|gross balance ' || s_suppkey || '|nation' || s_nationkey AS aliases,
    'Balance of ' || s_name AS business_definition,
    CASE WHEN s_suppkey % 7 <> 0 THEN 'sum(balance_' || s_suppkey || ')' END AS formula,
    list_sort(list_distinct(list_transform(
      [(s_suppkey * 17 + 1) % np, (s_suppkey * 31 + 5) % np, (s_suppkey * 7 + 2) % np][1:(s_suppkey % 3 + 1)],
      lambda x: printf('TBL-%04d', x)))) AS sources,
    printf('EMP-%04d', (s_suppkey * 11 + 6) % (SELECT count(*) FROM customer)) AS owner_id
  FROM (SELECT *, (SELECT count(*) FROM part) AS np FROM supplier) s""")
view("medges", "SELECT metric_id, unnest(sources) AS table_id FROM {metrics}")
view("requests", """
  SELECT doc_id AS k, printf('REQ-%04d', doc_id) AS request_id,
    string_split(text, chr(10))[1] AS title, text AS description,
    printf('EMP-%04d', doc_id * 3 % np) AS requester_id,
    printf('EMP-%04d', (doc_id * 7 + 1) % np) AS assignee_id, lang AS department,
    DATE '2020-01-01' + (doc_id % 700)::INT AS created_date,
    CASE WHEN status IN ('done', 'duplicate')
      THEN DATE '2020-01-01' + (doc_id % 700 + n_chars % 90)::INT END AS closed_date,
    status,
    CASE WHEN status = 'done' AND doc_id % 4 <> 0 THEN printf('RPT-%04d', doc_id * 5 % nr) END
      AS resulting_report_id,
    CASE WHEN status = 'duplicate' THEN printf('REQ-%04d', doc_id - 1) END
      AS duplicate_of_request_id
  FROM (SELECT *, (SELECT count(*) FROM customer) AS np, (SELECT count(*) FROM orders) AS nr,
    CASE doc_id % 10 WHEN 5 THEN 'duplicate' WHEN 6 THEN 'open' WHEN 7 THEN 'rejected'
      WHEN 8 THEN 'in_progress' ELSE 'done' END AS status FROM documents) d""")
view("assets", """
  SELECT report_id AS asset_id, 'report' AS type, name, owner_id, status, NULL AS layer, usage_30d
    FROM {reports}
  UNION ALL SELECT table_id, 'table', name, owner_id, NULL, layer, NULL FROM {tables}
  UNION ALL SELECT metric_id, 'metric', name, owner_id, NULL, NULL, NULL FROM {metrics}""")
view("edges", """
  SELECT parent_table_id AS src, child_table_id AS dst, 'table_table' AS kind FROM {tedges}
  UNION SELECT table_id, report_id, 'table_report' FROM {redges}
  UNION SELECT table_id, metric_id, 'table_metric' FROM {medges}""")
# Pairs (ancestor, descendant) between tables, by following parents upward.
view("treach", """
  SELECT a AS seed, child_table_id AS node FROM (
    WITH RECURSIVE up(child_table_id, a) AS (
      SELECT child_table_id, parent_table_id FROM {tedges}
      UNION SELECT u.child_table_id, e.parent_table_id FROM up u
        JOIN {tedges} e ON e.child_table_id = u.a)
    SELECT * FROM up) r""")
# Everything a table reaches, itself included.
view("treach0", """
  SELECT seed, node FROM {treach} UNION ALL SELECT table_id, table_id FROM {tables}""")
# Ownership walks as one recursive relation: every step of every departed owner.
view("walks", """
  SELECT * FROM (
    WITH RECURSIVE w(owner, cur, status, nxt, via, hops, path) AS (
      SELECT employee_id, employee_id, status, coalesce(successor_id, manager_id),
        CASE WHEN successor_id IS NOT NULL THEN 'successor' ELSE 'manager' END, 0::BIGINT,
        [employee_id] FROM {employees}
      UNION ALL
      SELECT w.owner, e.employee_id, e.status, coalesce(e.successor_id, e.manager_id),
        CASE WHEN e.successor_id IS NOT NULL THEN 'successor' ELSE 'manager' END, w.hops + 1,
        list_append(w.path, e.employee_id)
      FROM w JOIN {employees} e ON e.employee_id = w.nxt
      WHERE w.status = 'left' AND w.hops < 3 AND NOT list_contains(w.path, w.nxt))
    SELECT * FROM w) x""")
view("contacts", """
  SELECT l.owner AS employee_id, l.department, l.status, l.hops, l.path,
    l.last_status <> 'left' AS resolved,
    CASE WHEN l.last_status <> 'left' AND l.hops = 0 THEN 'active_owner'
      WHEN l.last_status <> 'left' THEN 'resolved_via_chain'
      WHEN l.hops = 3 THEN 'depth_limit' WHEN l.nxt IS NULL THEN 'dead_end' ELSE 'cycle' END
      AS reason,
    CASE WHEN l.last_status <> 'left' THEN l.cur ELSE h.head_id END AS contact_id,
    CASE WHEN l.last_status <> 'left' THEN l.cur END AS resolved_owner_id,
    CASE WHEN l.last_status = 'left' THEN h.head_id END AS fallback_contact_id
  FROM (SELECT w.owner, e.department, e.status, max(w.hops) AS hops,
      max_by(w.path, w.hops) AS path, max_by(w.status, w.hops) AS last_status,
      max_by(w.cur, w.hops) AS cur, arg_max_null(w.nxt, w.hops) AS nxt
    FROM {walks} w JOIN {employees} e ON e.employee_id = w.owner GROUP BY ALL) l
  JOIN {heads} h ON h.department = l.department""")
view("ireports", """
  SELECT DISTINCT t.seed, e.report_id FROM {treach0} t JOIN {redges} e ON e.table_id = t.node""")
view("imetrics", """
  SELECT DISTINCT t.seed, e.metric_id FROM {treach0} t JOIN {medges} e ON e.table_id = t.node""")
view("inotify", """
  SELECT seed AS table_id, contact_id AS employee_id, count(report_id)::BIGINT AS report_count,
    count(metric_id)::BIGINT AS metric_count, coalesce(sum(usage_30d), 0)::BIGINT AS total_usage_30d,
    bool_or(NOT resolved) AS via_fallback,
    sum(length(coalesce(report_id, metric_id)) + 2)::BIGINT AS id_chars
  FROM (SELECT i.seed, c.contact_id, c.resolved, r.report_id, NULL AS metric_id, r.usage_30d
      FROM {ireports} i JOIN {reports} r USING (report_id)
      JOIN {contacts} c ON c.employee_id = r.owner_id WHERE r.status = 'active'
    UNION ALL SELECT i.seed, c.contact_id, c.resolved, NULL, m.metric_id, 0
      FROM {imetrics} i JOIN {metrics} m USING (metric_id)
      JOIN {contacts} c ON c.employee_id = m.owner_id) a
  GROUP BY ALL""")
view("inotify_ranked", """
  SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY total_usage_30d DESC, employee_id)
    AS rank, count(*) OVER (PARTITION BY table_id) AS people FROM {inotify}""")
view("inotify_list", "SELECT * FROM {inotify_ranked} WHERE people <= 20 OR rank <= 10")
view("irollup", """
  SELECT table_id, department, head_id AS head_employee_id, count(*)::BIGINT AS people_count,
    sum(report_count)::BIGINT AS report_count
  FROM {inotify_ranked} i JOIN {employees} e USING (employee_id) JOIN {heads} h USING (department)
  WHERE people > 20 GROUP BY ALL""")
view("iunresolved", """
  SELECT i.seed, r.report_id AS asset_id FROM {ireports} i JOIN {reports} r USING (report_id)
    JOIN {contacts} c ON c.employee_id = r.owner_id WHERE r.status = 'active' AND NOT c.resolved
  UNION ALL SELECT i.seed, m.metric_id FROM {imetrics} i JOIN {metrics} m USING (metric_id)
    JOIN {contacts} c ON c.employee_id = m.owner_id WHERE NOT c.resolved""")
view("isummary", """
  SELECT t.table_id, coalesce(n.people, 0)::BIGINT AS notify_total_count,
    CASE WHEN coalesce(n.people, 0) <= 20 THEN 'individual' ELSE 'broadcast' END AS notify_mode,
    CASE WHEN coalesce(n.people, 0) <= 20 THEN 0 ELSE n.people - 10 END::BIGINT AS notify_omitted_count,
    coalesce(r.n, 0)::BIGINT AS affected_report_count, coalesce(m.n, 0)::BIGINT AS affected_metric_count,
    coalesce(d.n, 0)::BIGINT AS affected_table_count, coalesce(u.n, 0)::BIGINT AS unresolved_count
  FROM {tables} t
  LEFT JOIN (SELECT table_id, count(*) AS people FROM {inotify} GROUP BY 1) n USING (table_id)
  LEFT JOIN (SELECT seed, count(*) AS n FROM {ireports} GROUP BY 1) r ON r.seed = t.table_id
  LEFT JOIN (SELECT seed, count(*) AS n FROM {imetrics} GROUP BY 1) m ON m.seed = t.table_id
  LEFT JOIN (SELECT seed, count(*) AS n FROM {treach} GROUP BY 1) d ON d.seed = t.table_id
  LEFT JOIN (SELECT seed, count(*) AS n FROM {iunresolved} GROUP BY 1) u ON u.seed = t.table_id""")
view("iitems", """
  SELECT *, row_number() OVER (PARTITION BY table_id, cut_order ORDER BY place, asset_id) AS rn
  FROM (SELECT i.seed AS table_id, 1 AS cut_order, -r.usage_30d AS place, r.report_id AS asset_id,
      length('{"report_id":"' || r.report_id || '","name":"' || r.name || '","status":"' || r.status
        || '","usage_30d":' || r.usage_30d || ',"notify_employee_id":'
        || CASE WHEN r.status = 'active' THEN '"' || c.contact_id || '"' ELSE 'null' END
        || ',"owner_resolved":' || CASE WHEN c.resolved THEN 'true' ELSE 'false' END || '}') AS chars
      FROM {ireports} i JOIN {reports} r USING (report_id)
      JOIN {contacts} c ON c.employee_id = r.owner_id
    UNION ALL SELECT seed, 2, 0, node, length(node) + 2 FROM {treach}
    UNION ALL SELECT seed, 3, 0, metric_id, length(metric_id) + 2 FROM {imetrics}
    UNION ALL SELECT seed, 4, 0, asset_id, length(asset_id) + 2 FROM {iunresolved}) x""")
view("ibase", """
  SELECT s.table_id, length('{"table_id":"' || s.table_id || '","notify_mode":"' || notify_mode
      || '","notify_total_count":' || notify_total_count || ',"notify_omitted_count":'
      || notify_omitted_count || ',"affected_report_count":' || affected_report_count
      || ',"affected_metric_count":' || affected_metric_count
      || ',"affected_tables":[],"affected_reports":[],"affected_metrics":[],"notify":['
      || '],"notify_rollup":[],"unresolved_asset_ids":[],"truncated":false}')
    + coalesce(p.chars, 0) + coalesce(r.chars, 0) AS base_chars
  FROM {isummary} s
  LEFT JOIN (SELECT table_id, sum(length('{"employee_id":"' || employee_id || '","full_name":"'
        || full_name || '","report_ids":[],"metric_ids":[],"total_usage_30d":' || total_usage_30d
        || ',"via_fallback":' || CASE WHEN via_fallback THEN 'true' ELSE 'false' END || '}')
        + id_chars + greatest(report_count - 1, 0) + greatest(metric_count - 1, 0) + 1) - 1 AS chars
      FROM {inotify_list} JOIN {employees} USING (employee_id) GROUP BY 1) p USING (table_id)
  LEFT JOIN (SELECT table_id, sum(length('{"department":"' || department
        || '","head_employee_id":"' || head_employee_id || '","people_count":' || people_count
        || ',"report_count":' || report_count || '}') + 1) - 1 AS chars
      FROM {irollup} GROUP BY 1) r USING (table_id)""")
view("ishown", """
  SELECT *, base_chars + total > 6000 AS cut FROM (
    SELECT i.*, b.base_chars, sum(chars + CASE WHEN rn > 1 THEN 1 ELSE 0 END)
        OVER (PARTITION BY table_id) AS total,
      sum(chars + CASE WHEN rn > 1 THEN 1 ELSE 0 END)
        OVER (PARTITION BY table_id ORDER BY cut_order DESC, rn) AS run
    FROM {iitems} i JOIN {ibase} b USING (table_id)) y
  WHERE base_chars + total <= 6000 OR (base_chars - 1 + run <= 6000 AND run < total)""")

# The whole answer about a table as JSON.
view("inotify_ids", """
  SELECT seed AS table_id, contact_id AS employee_id, report_id, NULL AS metric_id
  FROM {ireports} JOIN {reports} r USING (report_id) JOIN {contacts} c ON c.employee_id = r.owner_id
  WHERE r.status = 'active'
  UNION ALL SELECT seed, contact_id, NULL, metric_id
  FROM {imetrics} JOIN {metrics} m USING (metric_id) JOIN {contacts} c ON c.employee_id = m.owner_id""")
view("ipeople", """
  SELECT table_id, list({'employee_id': employee_id, 'full_name': full_name, 'report_ids': report_ids,
    'metric_ids': metric_ids, 'total_usage_30d': total_usage_30d, 'via_fallback': via_fallback} ORDER BY rank) AS notify
  FROM (SELECT l.table_id, l.employee_id, l.rank, l.total_usage_30d, l.via_fallback,
      coalesce(list(a.report_id ORDER BY a.report_id) FILTER (a.report_id IS NOT NULL), []) AS report_ids,
      coalesce(list(a.metric_id ORDER BY a.metric_id) FILTER (a.metric_id IS NOT NULL), []) AS metric_ids
    FROM {inotify_list} l JOIN {inotify_ids} a USING (table_id, employee_id) GROUP BY ALL) p
  JOIN {employees} USING (employee_id) GROUP BY table_id""")
view("idepartments", """
  SELECT table_id, list({'department': department, 'head_employee_id': head_employee_id, 'people_count': people_count,
    'report_count': report_count} ORDER BY people_count DESC, department) AS notify_rollup FROM {irollup} GROUP BY 1""")
view("ilists", """
  SELECT i.table_id, list(i.asset_id ORDER BY rn) FILTER (cut_order = 2) AS affected_tables,
    list({'report_id': r.report_id, 'name': r.name, 'status': r.status, 'usage_30d': r.usage_30d,
      'notify_employee_id': CASE WHEN r.status = 'active' THEN c.contact_id END, 'owner_resolved': c.resolved} ORDER BY rn)
      FILTER (cut_order = 1) AS affected_reports,
    list(i.asset_id ORDER BY rn) FILTER (cut_order = 3) AS affected_metrics,
    list(i.asset_id ORDER BY rn) FILTER (cut_order = 4) AS unresolved_asset_ids, bool_or(cut) AS cut
  FROM {ishown} i LEFT JOIN {reports} r ON r.report_id = i.asset_id AND cut_order = 1
  LEFT JOIN {contacts} c ON c.employee_id = r.owner_id GROUP BY 1""")
view("ipayloads", """
  SELECT s.table_id, coalesce(cut, false) AS truncated, to_json({'table_id': s.table_id, 'notify_mode': notify_mode,
    'notify_total_count': notify_total_count, 'notify_omitted_count': notify_omitted_count,
    'affected_report_count': affected_report_count, 'affected_metric_count': affected_metric_count,
    'affected_tables': coalesce(affected_tables, []), 'affected_reports': coalesce(affected_reports, []),
    'affected_metrics': coalesce(affected_metrics, []), 'notify': coalesce(notify, []),
    'notify_rollup': coalesce(notify_rollup, []), 'unresolved_asset_ids': coalesce(unresolved_asset_ids, []),
    'truncated': coalesce(cut, false)})::VARCHAR AS payload
  FROM {isummary} s LEFT JOIN {ilists} USING (table_id) LEFT JOIN {ipeople} USING (table_id)
  LEFT JOIN {idepartments} USING (table_id)""")


def _needs(sql: str) -> list[str]:
    return [name for name in VIEWS if "{" + name + "}" in sql]


def with_views(sql: str, names: list[str]) -> str:
    """The query with every view it names (directly or through another) as a CTE before it."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for needed in _needs(VIEWS[name]):
            add(needed)
        ordered.append(name)

    wanted = list(dict.fromkeys([*names, *_needs(sql)]))
    for name in wanted:
        add(name)

    def fill(text: str) -> str:
        for name in ordered:
            text = text.replace("{" + name + "}", name + "_v")
        return text

    if not ordered:
        return sql
    ctes = ",\n".join(f"{n}_v AS MATERIALIZED ({fill(VIEWS[n])})" for n in ordered)
    body = fill(sql)
    if body.lstrip().upper().startswith("WITH "):
        body = f"SELECT * FROM ({body}) q"
    return f"WITH {ctes}\n{body}"
