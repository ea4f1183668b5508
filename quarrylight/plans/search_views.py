"""SQL views of the search corpora, written without the Spark operators' intermediate tables."""

from __future__ import annotations

from quarrylight.functions.text import FUNCTION_WORDS, STOP_WORDS
from quarrylight.plans.oracle_views import view

STOPS = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")"
FUNCTIONS = "(" + ", ".join(f"'{w}'" for w in STOP_WORDS + FUNCTION_WORDS) + ")"


def tokens_sql(text: str) -> str:
    """The token list of a text expression."""
    parts = "list_filter(string_split_regex(t, '[_%-]+'), lambda p: p <> '')"
    whole = (
        f"CASE WHEN t = '' OR (t <> '%' AND len({parts}) = 0) OR t IN {STOPS}"
        " THEN []::VARCHAR[] ELSE [t] END"
    )
    inside = (
        f"CASE WHEN len({parts}) > 1 OR (len({parts}) = 1 AND {parts}[1] <> t)"
        f" THEN list_filter({parts}, lambda p: p NOT IN {STOPS}) ELSE []::VARCHAR[] END"
    )
    runs = f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_%-]+')"
    return (
        f"flatten(list_transform(list_transform({runs}, lambda r: trim(r, '_-')),"
        f" lambda t: list_concat({whole}, {inside})))"
    )


def norm_sql(text: str) -> str:
    return f"' ' || array_to_string(regexp_extract_all(lower({text}), '[a-z0-9]+'), ' ') || ' '"


def word_set_sql(text: str) -> str:
    return (
        f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'),"
        f" lambda w: w NOT IN {STOPS}))"
    )


def sentence_sql(text: str) -> str:
    return f"CASE WHEN trim({text}) <> '' THEN rtrim(trim({text}), '.') || '.' END"


_RID = r"\b(?:EMP|RPT|TBL|MET|REQ)-[0-9]{3,}\b"

view("asset_docs", f"""
  SELECT report_id AS doc_id, 'report' AS kind,
    concat_ws(' ', report_id, name, name, name, replace(tags, '|', ' '), replace(tags, '|', ' '),
      workspace, department, description) AS bm25_text,
    concat_ws(' ', {sentence_sql("name")}, {sentence_sql("description")},
      {sentence_sql("'Tags: ' || replace(tags, '|', ', ')")}) AS dense_text,
    department, status, [name] AS exact_names FROM {{reports}}
  UNION ALL
  SELECT table_id, 'table', concat_ws(' ', table_id, name, name, name, layer, schema_name,
      source_system, array_to_string(regexp_extract_all(columns_json, '"name":"([^"]*)"', 1), ' '),
      t.description),
    concat_ws(' ', {sentence_sql("name")}, {sentence_sql("t.description")}), e.department, NULL, [name]
  FROM {{tables}} t JOIN {{employees}} e ON e.employee_id = t.owner_id
  UNION ALL
  SELECT metric_id, 'metric', concat_ws(' ', metric_id, name, name, name,
      replace(aliases, '|', ' '), replace(aliases, '|', ' '), replace(aliases, '|', ' '),
      business_definition, formula),
    concat_ws(' ', {sentence_sql("name")}, {sentence_sql("business_definition")},
      {sentence_sql("'Tags: ' || replace(aliases, '|', ', ')")}), e.department, NULL,
    list_concat([name], list_filter(string_split(aliases, '|'), lambda a:
      regexp_matches(a, '^[A-Z0-9%&]{{2,}}$')
      OR len(regexp_extract_all(lower(a), '[a-z0-9]+')) >= 2))
  FROM {{metrics}} m JOIN {{employees}} e ON e.employee_id = m.owner_id""".replace("{{", "{").replace("}}", "}"))
view("request_docs", f"""
  SELECT request_id AS doc_id, 'request' AS kind,
    concat_ws(' ', request_id, nullif(title, ''), nullif(title, ''), nullif(description, ''))
      AS bm25_text,
    concat_ws(' ', {sentence_sql("title")}, {sentence_sql("description")}) AS dense_text,
    department, status, []::VARCHAR[] AS exact_names FROM {{requests}}""".replace("{{", "{").replace("}}", "}"))
view("request_queries", """
  SELECT 'Q-' || item_id AS query_id, text, NULL::VARCHAR[] AS kinds,
    CASE WHEN item_id % 2 = 1 THEN 'en' END AS department, true AS include_deprecated,
    5 AS top_k FROM benchmark""")
view("asset_queries", """
  SELECT 'Q-' || b AS query_id,
    'who owns ' || CASE b % 3
      WHEN 0 THEN CASE first_key % 3 WHEN 0 THEN 'stg ' WHEN 1 THEN 'int ' ELSE 'dim ' END
        || first_name || ' ' || first_key
      WHEN 1 THEN printf('tbl-%04d', first_key) || ' ' || first_name
      ELSE first_name || ' view' END || ' of brand ' || b AS text,
    CASE b % 4 WHEN 0 THEN NULL WHEN 1 THEN ['table'] WHEN 2 THEN ['report', 'metric']
      ELSE ['table', 'report', 'metric'] END AS kinds,
    CASE b % 2 WHEN 1 THEN 'BUILDING' END AS department, b % 3 <> 0 AS include_deprecated,
    5 + b % 6 AS top_k
  FROM (SELECT substr(p_brand, 7)::INT AS b, min(p_partkey) AS first_key,
    min_by(p_name, p_partkey) AS first_name FROM part GROUP BY 1) x""")


def search_views(p: str, docs: str, queries: str) -> None:
    """The whole search over one corpus: {p}_bm25, _rank_bm25, _cos, _rank_dense, _fused, _signal."""
    ok = (
        "(q.kinds IS NULL OR list_contains(q.kinds, d.kind))"
        " AND (q.department IS NULL OR q.department = d.department)"
        " AND (q.include_deprecated OR d.status IS DISTINCT FROM 'deprecated')"
    )
    view(f"{p}_tf", f"""
      SELECT doc_id, token, count(*) AS tf FROM (
        SELECT doc_id, unnest({tokens_sql("bm25_text")}) AS token FROM {{{docs}}}) x GROUP BY ALL""")
    view(f"{p}_dl", f"""
      SELECT doc_id, coalesce(dl, 0)::BIGINT AS dl FROM {{{docs}}} LEFT JOIN
        (SELECT doc_id, sum(tf) AS dl FROM {{{p}_tf}} GROUP BY 1) x USING (doc_id)""")
    view(f"{p}_idf", f"""
      SELECT token, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM (
        SELECT token, count(*) AS df, ln((SELECT count(*) FROM {{{docs}}})::DOUBLE - count(*) + 0.5)
          - ln(count(*) + 0.5) AS raw FROM {{{p}_tf}} GROUP BY 1) x""")
    view(f"{p}_bm25", f"""
      SELECT q.query_id, f.doc_id, (sum(round(qtf * (idf * (f.tf * 2.5::DOUBLE)
          / (f.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / (SELECT avg(dl) FROM {{{p}_dl}})))) * 1e9)::HUGEINT)
          / 1e9)::DOUBLE AS score
      FROM (SELECT query_id, any_value(kinds) AS kinds, any_value(department) AS department,
          any_value(include_deprecated) AS include_deprecated, token, count(*) AS qtf
        FROM (SELECT *, unnest({tokens_sql("text")}) AS token FROM {{{queries}}}) x
        GROUP BY query_id, token) q
      JOIN {{{p}_idf}} i ON i.token = q.token JOIN {{{p}_tf}} f ON f.token = q.token
      JOIN {{{p}_dl}} l ON l.doc_id = f.doc_id JOIN {{{docs}}} d ON d.doc_id = f.doc_id AND {ok}
      GROUP BY ALL""")
    view(f"{p}_rank_bm25", f"""
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)
        AS rank FROM {{{p}_bm25}}) x WHERE rank <= 50""")
    for side, source, key, text in (
        ("emb", docs, "doc_id", "dense_text"), ("qemb", queries, "query_id", "text")
    ):
        view(f"{p}_{side}", f"""
          SELECT {key}, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS v FROM (
            SELECT {key}, ('0x' || substr(md5(token), 1, 8))::BIGINT % 64 AS bucket,
              sum(CASE WHEN ('0x' || substr(md5(token), 9, 2))::BIGINT % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS v
            FROM (SELECT {key}, unnest({tokens_sql(text)}) AS token FROM {{{source}}}) x GROUP BY ALL) y
          WHERE v <> 0""")
    view(f"{p}_cos", f"""
      SELECT q.query_id, d.doc_id, round(coalesce(c.cosine, 0), 9) + 0.0::DOUBLE AS cosine
      FROM {{{queries}}} q JOIN {{{docs}}} d ON {ok}
      LEFT JOIN (SELECT query_id, doc_id, sum(a.v * b.v) AS cosine FROM {{{p}_qemb}} a
        JOIN {{{p}_emb}} b USING (bucket) GROUP BY ALL) c
        ON c.query_id = q.query_id AND c.doc_id = d.doc_id""")
    view(f"{p}_rank_dense", f"""
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id)
        AS rank FROM {{{p}_cos}}) x WHERE rank <= 50""")
    view(f"{p}_fused", f"""
      SELECT query_id, doc_id, score, bm25_rank, dense_rank,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
      FROM (SELECT query_id, doc_id, coalesce(1.0::DOUBLE / (60 + b.rank), 0.0::DOUBLE)
          + coalesce(1.0::DOUBLE / (60 + d.rank), 0.0::DOUBLE) AS score,
          b.rank AS bm25_rank, d.rank AS dense_rank
        FROM {{{p}_rank_bm25}} b FULL JOIN {{{p}_rank_dense}} d USING (query_id, doc_id)) x""")
    view(f"{p}_exact", f"""
      SELECT DISTINCT q.query_id FROM {{{queries}}} q JOIN {{{docs}}} d ON {ok}
      WHERE list_contains(regexp_extract_all(upper(q.text), '{_RID}'), d.doc_id)
        OR len(list_filter(d.exact_names, lambda n: trim({norm_sql("n")}) <> ''
          AND contains({norm_sql("q.text")}, {norm_sql("n")}))) > 0""")
    view(f"{p}_signal", f"""
      SELECT query_id, exact_match, top_cosine, dense_z,
        CASE WHEN exact_match OR dense_z >= 4.25 THEN 'strong' ELSE 'weak' END AS match_quality
      FROM (SELECT q.query_id, q.query_id IN (SELECT query_id FROM {{{p}_exact}}) AS exact_match,
          coalesce(max(cosine), 0.0) AS top_cosine,
          CASE WHEN stddev_pop(cosine) > 1e-12 THEN (max(cosine) - avg(cosine)) / stddev_pop(cosine)
            ELSE 0.0 END AS dense_z
        FROM {{{queries}}} q LEFT JOIN {{{p}_cos}} c USING (query_id) GROUP BY q.query_id) x""")


search_views("ra", "asset_docs", "asset_queries")
search_views("rr", "request_docs", "request_queries")
