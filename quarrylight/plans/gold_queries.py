"""Queries over gold answers, baselines and the retrieval benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions.text import content_overlap, words_array
from quarrylight.operators import bench, gold, lineage
from quarrylight.plans.bindings import catalog, source
from quarrylight.plans.oracle_views import view
from quarrylight.plans.quality_queries import designed_pairs, topics
from quarrylight.plans.registry import query
from quarrylight.plans.run_bindings import items
from quarrylight.plans.run_queries import r6
from quarrylight.plans.search_queries import all_modes
from quarrylight.plans.search_views import FUNCTIONS, word_set_sql
from quarrylight.sources.catalog import assets, metric_sources

# ------------------------------------------------------------------ gold


@query("gold_asset_by_description", """
SELECT d.a AS item_id, x.id AS record_id, x.f AS forbidden,
  CASE WHEN x.id NOT IN (SELECT asset_id FROM {assets}) THEN 'unknown asset' END AS error
FROM {designed} d, LATERAL (SELECT d.a AS id, false AS f UNION ALL SELECT d.b, true) x""")
def gold_asset_by_description(spark, sf):
    specs = designed_pairs(spark, sf).select(
        F.col("a").alias("item_id"), F.col("a").alias("target_id"), F.array("b").alias("forbidden_ids")
    )
    return gold.described_assets(catalog(spark, sf), specs)


view("contact_specs", """
  SELECT metric_id AS item_id, table_id AS asset_id FROM {medges}
  UNION ALL SELECT asset_id, asset_id FROM {assets}""")
view("gold_contacts", """
  SELECT item_id, contact_id AS record_id, false AS forbidden FROM (SELECT DISTINCT s.item_id, c.contact_id
    FROM {contact_specs} s JOIN {assets} a USING (asset_id) JOIN {contacts} c ON c.employee_id = a.owner_id) x
  UNION ALL SELECT DISTINCT s.item_id, a.owner_id, true FROM {contact_specs} s JOIN {assets} a USING (asset_id)
    JOIN {contacts} c ON c.employee_id = a.owner_id WHERE c.status = 'left' AND (s.item_id, a.owner_id) NOT IN (
      SELECT (s.item_id, c.contact_id) FROM {contact_specs} s JOIN {assets} a USING (asset_id)
      JOIN {contacts} c ON c.employee_id = a.owner_id)""")


def contact_specs(spark, sf):
    """Every asset on its own, and every metric with its source tables."""
    cat = catalog(spark, sf)
    several = metric_sources(cat).select(F.col("metric_id").alias("item_id"), F.col("table_id").alias("asset_id"))
    return several.union(assets(cat).select(F.col("asset_id").alias("item_id"), "asset_id"))


@query("gold_current_contact", "SELECT item_id, record_id, forbidden FROM {gold_contacts}")
def gold_current_contact(spark, sf):
    return gold.current_contacts(catalog(spark, sf), contact_specs(spark, sf))


@query("gold_upstream_tables", """
SELECT m.metric_id AS seed, u.node FROM {metrics} m JOIN (
  SELECT metric_id, table_id AS node FROM {medges}
  UNION SELECT m.metric_id, e.parent_table_id FROM {medges} m JOIN {tedges} e ON e.child_table_id = m.table_id
  UNION SELECT m.metric_id, f.parent_table_id FROM {medges} m JOIN {tedges} e ON e.child_table_id = m.table_id
    JOIN {tedges} f ON f.child_table_id = e.parent_table_id) u USING (metric_id)""")
def gold_upstream_tables(spark, sf):
    cat = catalog(spark, sf)
    asked = cat.metrics.select(F.col("metric_id").alias("seed"), F.lit(3).alias("depth"))
    return lineage.upstream_tables(cat, asked).select("seed", "node")


@query("gold_downstream_reports", """
SELECT t.table_id AS seed, r.report_id FROM {tables} t JOIN (
  SELECT table_id, report_id FROM {redges}
  UNION SELECT e.parent_table_id, r.report_id FROM {tedges} e JOIN {redges} r ON r.table_id = e.child_table_id) r
  USING (table_id) WHERE t.layer = 'staging'""")
def gold_downstream_reports(spark, sf):
    cat = catalog(spark, sf)
    asked = cat.tables.where("layer = 'staging'").select(
        F.col("table_id").alias("seed"), F.lit(2).alias("depth")
    )
    return lineage.downstream_reports(cat, asked).select("seed", "report_id")


@query("gold_similar_requests", """
SELECT s.item_id, t.request_id AS record_id, CASE WHEN t.request_id IS NULL THEN 'no requests for topic' END AS error
FROM (SELECT 'C-' || event_id AS item_id, printf('T-%05d', event_id) AS topic_key FROM events) s
LEFT JOIN {topics} t USING (topic_key)""")
def gold_similar_requests(spark, sf):
    specs = source(spark, sf, "events").selectExpr(
        "concat('C-', event_id) AS item_id", "format_string('T-%05d', event_id) AS topic_key"
    )
    return gold.similar_requests(specs, topics(spark, sf)).drop("forbidden")


view("gold_notify", """
  SELECT table_id, employee_id AS record_id, false AS forbidden, NULL::BIGINT AS min_mentioned_count
  FROM {inotify_ranked} WHERE people <= 20
  UNION ALL SELECT n.table_id, h.head_id, h.department NOT IN (SELECT e.department FROM {inotify_ranked} x
      JOIN {employees} e USING (employee_id) WHERE x.table_id = n.table_id), n.people
  FROM (SELECT DISTINCT table_id, people FROM {inotify_ranked} WHERE people > 20) n, {heads} h""")


@query("gold_impact_notify", "SELECT table_id, record_id, forbidden, min_mentioned_count FROM {gold_notify}")
def gold_impact_notify(spark, sf):
    return gold.impact_notify(catalog(spark, sf))


@query("gold_abstain", "SELECT item_id, should_abstain FROM {items} WHERE should_abstain")
def gold_abstain(spark, sf):
    return items(spark, sf).where("gold_type = 'abstain'").select(
        "item_id", F.lit(True).alias("should_abstain")
    )


def chain_specs(spark, sf):
    """Every metric as a chained question: source tables first, then a contact, a topic or parents."""
    cat = catalog(spark, sf)
    number = F.split("metric_id", "-")[1].cast("bigint")
    step = lambda kind, i, depth: F.struct(
        F.lit(kind).alias("type"), i.alias("id"), F.lit(depth).alias("depth"))
    first = step("upstream_tables", F.col("metric_id"), 1)
    last = (
        F.when(number % 3 == 0, step("current_contact_for_asset", F.col("metric_id"), 0))
        .when(number % 3 == 1, step("similar_requests", F.format_string("T-%05d", number), 0))
        .otherwise(step("upstream_tables", F.col("metric_id"), 2))
    )
    return cat.metrics.select(F.col("metric_id").alias("item_id"), F.array(first, last).alias("steps"))


@query("gold_chain", """
SELECT g.item_id, g.record_id, g.forbidden FROM {gold_contacts} g JOIN {metrics} m ON m.metric_id = g.item_id
  WHERE m.k % 3 = 0 AND (g.item_id, g.record_id) IN (SELECT (m.metric_id, c.contact_id) FROM {metrics} m
    JOIN {contacts} c ON c.employee_id = m.owner_id UNION ALL SELECT (m.metric_id, m.owner_id) FROM {metrics} m)
  AND (NOT g.forbidden OR g.record_id = m.owner_id)
  AND (g.forbidden OR g.record_id = (SELECT c.contact_id FROM {contacts} c WHERE c.employee_id = m.owner_id))
UNION ALL SELECT m.metric_id, t.request_id, false FROM {metrics} m JOIN {topics} t
  ON t.topic_key = printf('T-%05d', m.k) WHERE m.k % 3 = 1
UNION ALL SELECT x.metric_id, x.node, false FROM {metrics} m JOIN (SELECT metric_id, table_id AS node FROM {medges}
  UNION SELECT m.metric_id, e.parent_table_id FROM {medges} m JOIN {tedges} e ON e.child_table_id = m.table_id) x
  ON x.metric_id = m.metric_id WHERE m.k % 3 = 2""")
def gold_chain(spark, sf):
    return gold.chain_gold(catalog(spark, sf), chain_specs(spark, sf), topics(spark, sf))


# ------------------------------------------------------------------ baselines


def named_tables(spark, sf):
    """The table a query of a brand is about: the lowest of the brand."""
    return source(spark, sf, "part").groupBy(F.expr("cast(substring(p_brand, 7) as int)").alias("b")).agg(
        F.min("p_partkey").alias("k")
    ).selectExpr("concat('Q-', b) AS query_id", "b", "k", "format_string('TBL-%04d', k) AS record_id")


view("named_tables", """
  SELECT 'Q-' || substr(p_brand, 7) AS query_id, substr(p_brand, 7)::INT AS b, min(p_partkey) AS k,
    printf('TBL-%04d', min(p_partkey)) AS record_id FROM part GROUP BY ALL""")


def past_work(spark, sf):
    """Benchmark passages and the documents that hold their sentences: a document that holds all
    sentences of a passage is the passage's past work."""
    cut = lambda df, key: df.select(key, F.explode(F.array_distinct(F.split("text", r"\. "))).alias("s"))
    passages = cut(source(spark, sf, "benchmark"), "item_id")
    held = cut(source(spark, sf, "documents"), "doc_id")
    sizes = passages.groupBy("item_id").agg(F.count("*").alias("n"))
    shared = passages.join(held, "s").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared"))
    return shared.join(sizes, "item_id").where("shared >= n - 1 AND shared >= 1").selectExpr(
        "concat('Q-', item_id) AS query_id", "format_string('REQ-%04d', doc_id) AS record_id"
    )


view("past_work", r"""
  SELECT 'Q-' || item_id AS query_id, printf('REQ-%04d', doc_id) AS record_id FROM (
    SELECT p.item_id, h.doc_id, any_value(p.n) AS n, count(*) AS shared FROM
      (SELECT item_id, unnest(list_distinct(string_split(text, '. '))) AS s,
        len(list_distinct(string_split(text, '. '))) AS n FROM benchmark) p
      JOIN (SELECT doc_id, unnest(list_distinct(string_split(text, '. '))) AS s FROM documents) h ON h.s = p.s
    GROUP BY ALL) x WHERE shared >= n - 1 AND shared >= 1""")


@query("baseline_always_abstain", "SELECT item_id, category, should_abstain AS correct FROM {items}")
def baseline_always_abstain(spark, sf):
    return gold.abstain_baseline(items(spark, sf))


view("top1_assets", """
  SELECT n.query_id AS item_id, EXISTS (SELECT 1 FROM {ra_fused} f WHERE f.query_id = n.query_id AND f.rank = 1
    AND f.doc_id = n.record_id) AS correct FROM {named_tables} n""")
view("top1_requests", """
  SELECT query_id AS item_id, bool_or((query_id, record_id) IN (SELECT (query_id, doc_id) FROM {rr_fused}
    WHERE rank = 1)) AS correct FROM {past_work} GROUP BY 1""")


@query("baseline_retrieval_top1", """
SELECT item_id, 'L1' AS category, correct FROM {top1_assets}
UNION ALL SELECT item_id, 'L4', correct FROM {top1_requests}""")
def baseline_retrieval_top1(spark, sf):
    first, second = _top1(spark, sf)
    return first.select("item_id", F.lit("L1").alias("category"), "correct").union(
        second.select("item_id", F.lit("L4"), "correct")
    )


def _top1(spark, sf):
    hybrid = lambda which: all_modes(spark, sf, which).hits.where("mode = 'hybrid'")
    return (
        gold.top_hit_baseline(hybrid("asset"), named_tables(spark, sf).select("query_id", "record_id")),
        gold.top_hit_baseline(hybrid("request"), past_work(spark, sf)),
    )


_RECORDED = """SELECT a.asset_id AS item_id, c.contact_id = a.owner_id AS correct FROM {assets} a
  JOIN {contacts} c ON c.employee_id = a.owner_id"""


@query("baseline_recorded_owner", _RECORDED)
def baseline_recorded_owner(spark, sf):
    return gold.recorded_owner_baseline(catalog(spark, sf))


_HEADS = """SELECT table_id AS item_id, NOT bool_or(forbidden) AS correct FROM {gold_notify}
  WHERE min_mentioned_count IS NOT NULL GROUP BY 1"""


@query("baseline_all_heads", _HEADS)
def baseline_all_heads(spark, sf):
    return gold.all_heads_baseline(catalog(spark, sf))


def _metric_requests(spark, sf):
    return catalog(spark, sf).metrics.select(
        F.col("metric_id").alias("seed"),
        (F.split("metric_id", "-")[1].cast("bigint") % 6 + 1).cast("int").alias("depth"),
    )


view("metric_dist", """
  SELECT metric_id, node, min(d) AS d FROM (
    WITH RECURSIVE u(metric_id, node, d) AS (SELECT metric_id, table_id, 1 FROM {medges}
      UNION SELECT u.metric_id, e.parent_table_id, u.d + 1 FROM u JOIN {tedges} e ON e.child_table_id = u.node
        WHERE u.d < 6) SELECT * FROM u) x GROUP BY ALL""")
_DEPTH = """
  SELECT item_id, depth, n_gold, n_given, CASE WHEN n_gold = 1 THEN hits = 1
    ELSE 2.0 * hits / (n_gold + n_given) >= 0.8 END AS correct FROM (
    SELECT m.metric_id AS item_id, (m.k % 6 + 1)::BIGINT AS depth, count(*) FILTER (d <= m.k % 6 + 1) AS n_gold,
      count(*) FILTER (d <= 3) AS n_given, count(*) FILTER (d <= least(m.k % 6 + 1, 3)) AS hits
    FROM {metrics} m JOIN {metric_dist} x USING (metric_id) GROUP BY ALL) y"""


@query("baseline_default_depth", _DEPTH)
def baseline_default_depth(spark, sf):
    return gold.default_depth_baseline(catalog(spark, sf), _metric_requests(spark, sf)).withColumn(
        "depth", F.col("depth").cast("bigint")
    )


@query("baseline_accuracy", f"""
SELECT baseline, category, count(*)::BIGINT AS n, round(avg(correct::INT), 6) AS accuracy FROM (
  SELECT 'always_abstain' AS baseline, 'all' AS category, should_abstain AS correct FROM {{items}}
  UNION ALL SELECT 'recorded_owner', 'L2', correct FROM ({_RECORDED}) a
  UNION ALL SELECT 'all_heads', 'L5', correct FROM ({_HEADS}) b
  UNION ALL SELECT 'default_depth_lineage', 'L3', correct FROM ({_DEPTH}) c
  UNION ALL SELECT 'retrieval_top1', 'L1', correct FROM {{top1_assets}}
  UNION ALL SELECT 'retrieval_top1', 'L4', correct FROM {{top1_requests}}) x GROUP BY ALL""".replace("{{", "{").replace("}}", "}"))
def baseline_accuracy(spark, sf):
    cat = catalog(spark, sf)
    first, second = _top1(spark, sf)
    scored = {
        ("always_abstain", "all"): gold.abstain_baseline(items(spark, sf)),
        ("recorded_owner", "L2"): gold.recorded_owner_baseline(cat),
        ("all_heads", "L5"): gold.all_heads_baseline(cat),
        ("default_depth_lineage", "L3"): gold.default_depth_baseline(cat, _metric_requests(spark, sf)),
        ("retrieval_top1", "L1"): first,
        ("retrieval_top1", "L4"): second,
    }
    return gold.baseline_accuracy(scored).select("baseline", "category", "n", *r6("accuracy"))


@query("score_sets", """
SELECT s.item_id, count(*) FILTER (g.forbidden = false)::BIGINT AS n_gold,
  count(*) FILTER (g.forbidden = false AND g.record_id = a.owner_id)::BIGINT AS hits,
  count(*) FILTER (g.forbidden AND g.record_id = a.owner_id)::BIGINT AS forbidden_given,
  count(*) FILTER (g.forbidden = false AND g.record_id = a.owner_id) = count(*) FILTER (g.forbidden = false)
    AND count(*) FILTER (g.forbidden AND g.record_id = a.owner_id) = 0 AS correct
FROM (SELECT asset_id AS item_id FROM {tables} t JOIN {assets} x ON x.asset_id = t.table_id) s
JOIN {assets} a ON a.asset_id = s.item_id JOIN {gold_contacts} g ON g.item_id = s.item_id GROUP BY 1""")
def score_sets(spark, sf):
    cat = catalog(spark, sf)
    asked = cat.tables.select(F.col("table_id").alias("item_id"), F.col("table_id").alias("asset_id"))
    wanted = gold.current_contacts(cat, asked)
    given = cat.tables.select(F.col("table_id").alias("item_id"), F.col("owner_id").alias("record_id"))
    rules = asked.select("item_id", F.lit("contains_all").alias("scoring"), F.lit(False).alias("abstained"))
    return gold.score_sets(wanted, given, rules).select(
        "item_id", "n_gold", "hits", "forbidden_given", "correct"
    )


# ------------------------------------------------------------------ retrieval benchmark
# Asset queries by brand: those that name a table or its ID are of type E, the others P or D.


def bench_items(spark, sf):
    return named_tables(spark, sf).selectExpr(
        "query_id", "record_id AS target", "format_string('TBL-%04d', k + 1) AS other",
        "CASE WHEN b % 7 = 0 THEN 'N' WHEN b % 3 < 2 THEN 'E' WHEN b % 2 = 0 THEN 'P' ELSE 'D' END AS type",
    )


view("bench_items", """
  SELECT query_id, record_id AS target, printf('TBL-%04d', k + 1) AS other,
    CASE WHEN b % 7 = 0 THEN 'N' WHEN b % 3 < 2 THEN 'E' WHEN b % 2 = 0 THEN 'P' ELSE 'D' END AS type
  FROM {named_tables}""")
view("ra_all", """
  SELECT 'bm25' AS mode, query_id, doc_id, r.rank FROM {ra_rank_bm25} r JOIN {asset_queries} q USING (query_id)
    WHERE r.rank <= q.top_k
  UNION ALL SELECT 'dense', query_id, doc_id, r.rank FROM {ra_rank_dense} r JOIN {asset_queries} q USING (query_id)
    WHERE r.rank <= q.top_k
  UNION ALL SELECT 'hybrid', query_id, doc_id, r.rank FROM {ra_fused} r JOIN {asset_queries} q USING (query_id)
    WHERE r.rank <= q.top_k""")
view("bench_records", """
  SELECT i.query_id, i.type, m.mode, min(h.rank) FILTER (h.doc_id = i.target) AS target_rank,
    min(h.rank) FILTER (h.doc_id = i.other) AS other_rank,
    coalesce(bool_or(h.rank <= 5 AND p.p_name = tp.p_name), false) AS topic_hit
  FROM {bench_items} i JOIN (SELECT DISTINCT query_id, mode FROM {ra_all}) m USING (query_id)
  JOIN {ra_all} h ON h.query_id = i.query_id AND h.mode = m.mode
  JOIN part tp ON printf('TBL-%04d', tp.p_partkey) = i.target
  LEFT JOIN part p ON printf('TBL-%04d', p.p_partkey) = h.doc_id
  GROUP BY ALL""")


def bench_records(spark, sf):
    """Records of the asset queries in all modes; the topic of a table is its part name."""
    hits = all_modes(spark, sf, "asset").hits
    wanted = bench_items(spark, sf)
    subjects = source(spark, sf, "part").selectExpr(
        "format_string('TBL-%04d', p_partkey) AS doc_id", "p_name AS topic"
    )
    records = bench.rank_of_target(hits, wanted)
    return records.join(bench.topic_hits(hits, wanted, subjects), ["query_id", "mode"], "left")


@query("rank_of_target", """
SELECT query_id, mode, target_rank::BIGINT AS target_rank, other_rank::BIGINT AS other_rank FROM {bench_records}""")
def rank_of_target(spark, sf):
    return bench_records(spark, sf).select(
        "query_id", "mode", F.col("target_rank").cast("bigint"), F.col("other_rank").cast("bigint")
    )


def _by_mode(name, sql, column):
    @query(name, f"SELECT mode, round({sql}, 6) AS {name} FROM {{bench_records}} WHERE type <> 'N' GROUP BY 1")
    def run(spark, sf):
        ranked = bench_records(spark, sf).where("type <> 'N'")
        return ranked.groupBy("mode").agg(F.round(column(), 6).alias(name))


_PAIR = "(coalesce(target_rank <= 5, false) AND coalesce(other_rank <= 5, false))"
_ABOVE = "(other_rank IS NOT NULL AND (target_rank IS NULL OR other_rank < target_rank))"
_by_mode("recall_at_k", "avg(coalesce(target_rank <= 5, false)::INT)", lambda: bench.recall_at(5))
_by_mode("mrr", "avg(coalesce(1.0 / target_rank, 0))", bench.mean_reciprocal_rank)
_by_mode("topic_hit_at_k", "avg(topic_hit::INT)", lambda: F.avg(F.col("topic_hit").cast("int")))
_by_mode("pair_coverage_at_k", f"avg({_PAIR}::INT)", lambda: F.avg(bench.pair_covered().cast("int")))
_by_mode("forbidden_above_target", f"avg({_ABOVE}::INT)", lambda: F.avg(bench.forbidden_first().cast("int")))
_MEASURES = ["recall_1", "recall_5", "mrr", "topic_hit_5", "pair_coverage_5", "forbidden_above_target"]
view("bench_summary", f"""
  SELECT mode, coalesce(type, 'all') AS type, count(*)::BIGINT AS n,
    avg(coalesce(target_rank <= 1, false)::INT) AS recall_1, avg(coalesce(target_rank <= 5, false)::INT) AS recall_5,
    avg(coalesce(1.0 / target_rank, 0)) AS mrr, avg(topic_hit::INT) AS topic_hit_5,
    avg({_PAIR}::INT) AS pair_coverage_5, avg({_ABOVE}::INT) AS forbidden_above_target
  FROM {{bench_records}} WHERE type <> 'N' GROUP BY GROUPING SETS ((mode, type), (mode))""".replace("{{", "{").replace("}}", "}"))


@query("bench_summary", "SELECT mode, type, n, " + ", ".join(f"round({m}, 6) AS {m}" for m in _MEASURES)
       + " FROM {bench_summary}")
def bench_summary(spark, sf):
    return bench.bench_summary(bench_records(spark, sf)).select("mode", "type", "n", *r6(*_MEASURES))


# Signal records: labelled documents, their truth and two measured values.
view("signals", """
  SELECT l.doc_id, l.quality = 1 AS truth, l.toxic = 1 AS exact_match, d.n_chars / 10000.0::DOUBLE AS cosine,
    d.n_chars / 1000.0::DOUBLE AS z, CASE WHEN l.doc_id % 2 = 0 THEN 'P' ELSE 'N' END AS type
  FROM labels l JOIN documents d USING (doc_id)""")


def signals(spark, sf):
    return source(spark, sf, "labels").join(source(spark, sf, "documents"), "doc_id").selectExpr(
        "doc_id", "quality = 1 AS truth", "toxic = 1 AS exact_match",
        "cast(n_chars as double) / 10000.0D AS cosine", "cast(n_chars as double) / 1000.0D AS z",
        "CASE WHEN doc_id % 2 = 0 THEN 'P' ELSE 'N' END AS type",
    )


def _macro_sql(pred: str) -> str:
    def f1(tp, fp, fn):
        return f"CASE WHEN {tp} > 0 THEN 2.0 * {tp} / (2 * {tp} + {fp} + {fn}) ELSE 0 END"

    ss, ws = f"count(*) FILTER (truth AND {pred})", f"count(*) FILTER (NOT truth AND {pred})"
    sw, ww = f"count(*) FILTER (truth AND NOT {pred})", f"count(*) FILTER (NOT truth AND NOT {pred})"
    return f"(({f1(ss, ws, sw)}) + ({f1(ww, sw, ws)})) / 2"


def _sweep_sql(value: str, grid: list[float]) -> str:
    taus = ", ".join(f"{t}::DOUBLE" for t in grid)
    pred = f"(exact_match OR {value} >= tau)"
    return (
        f"SELECT tau, {_macro_sql(pred)} AS macro_f1, coalesce(count(*) FILTER (truth AND {pred})::DOUBLE /"
        f" nullif(count(*) FILTER (truth), 0), 0) AS strong_rate_positive, coalesce(count(*) FILTER (NOT truth AND NOT"
        f" {pred})::DOUBLE / nullif(count(*) FILTER (NOT truth), 0), 0) AS weak_rate_negative"
        f" FROM {{signals}}, (SELECT unnest([{taus}]) AS tau) g GROUP BY tau"
    )


view("sweep_c", _sweep_sql("cosine", bench.TAU_GRID))
view("sweep_z", _sweep_sql("z", bench.TAU_Z_GRID))


@query("macro_f1", f"SELECT round({_macro_sql('(exact_match OR cosine >= 0.1)')}, 6) AS macro_f1 FROM {{signals}}")
def macro_f1(spark, sf):
    predicted = signals(spark, sf).withColumn("predicted", F.col("exact_match") | (F.col("cosine") >= 0.1))
    return bench.macro_f1(predicted).select(*r6("macro_f1"))


_RATES = ["macro_f1", "strong_rate_positive", "weak_rate_negative"]


@query("threshold_sweep", "SELECT tau, " + ", ".join(f"round({m}, 6) AS {m}" for m in _RATES) + " FROM {sweep_z}")
def threshold_sweep(spark, sf):
    return bench.threshold_sweep(signals(spark, sf), "z", bench.TAU_Z_GRID).select("tau", *r6(*_RATES))


def _tau_sql(view_name: str) -> str:
    return (
        "SELECT tau, f AS macro_f1 FROM (SELECT tau, f, row_number() OVER (ORDER BY tau) AS rn, count(*) OVER () AS n"
        f" FROM (SELECT tau, round(macro_f1, 4) AS f FROM {{{view_name}}}) a WHERE f = (SELECT max(round(macro_f1, 4))"
        f" FROM {{{view_name}}})) b WHERE rn = (n - 1) // 2 + 1"
    )


view("tau_c", _tau_sql("sweep_c"))
view("tau_z", _tau_sql("sweep_z"))


@query("choose_tau", "SELECT tau, macro_f1 FROM {tau_z}")
def choose_tau(spark, sf):
    return bench.choose_tau(bench.threshold_sweep(signals(spark, sf), "z", bench.TAU_Z_GRID))


@query("threshold_plateau_median", "SELECT tau, macro_f1 FROM {tau_c}")
def threshold_plateau_median(spark, sf):
    return bench.choose_tau(bench.threshold_sweep(signals(spark, sf), "cosine", bench.TAU_GRID))


@query("choose_signal", """
SELECT CASE WHEN z.macro_f1 > c.macro_f1 THEN 'z' ELSE 'cosine' END AS kind,
  CASE WHEN z.macro_f1 > c.macro_f1 THEN z.tau ELSE c.tau END AS threshold,
  greatest(z.macro_f1, c.macro_f1) AS macro_f1 FROM {tau_c} c, {tau_z} z""")
def choose_signal(spark, sf):
    records = signals(spark, sf)
    return bench.choose_signal(
        bench.threshold_sweep(records, "cosine", bench.TAU_GRID),
        bench.threshold_sweep(records, "z", bench.TAU_Z_GRID),
    )


@query("signal_equals_exact", "SELECT NOT bool_or(NOT exact_match AND z >= 4.25) AS only_exact FROM {signals}")
def signal_equals_exact(spark, sf):
    return bench.signal_equals_exact(signals(spark, sf), "z", 4.25)


@query("signal_extras", "SELECT type, count(*) FILTER (NOT exact_match AND z >= 4.25)::BIGINT AS extras"
       " FROM {signals} GROUP BY 1")
def signal_extras(spark, sf):
    return bench.signal_extras(signals(spark, sf), "z", 4.25)


# Three models in name order against the incumbent; equal macro-F1, so only MRR can decide.
@query("choose_model", """
SELECT CASE WHEN d - greatest(CASE WHEN b - h >= 0.02 THEN b ELSE h END, 0) >= 0.02 THEN 'dense'
  WHEN b - h >= 0.02 THEN 'bm25' ELSE 'hybrid' END AS model
FROM (SELECT max(mrr) FILTER (mode = 'bm25') AS b, max(mrr) FILTER (mode = 'dense') AS d,
  max(mrr) FILTER (mode = 'hybrid') AS h FROM {bench_summary} WHERE type = 'all') x""")
def choose_model(spark, sf):
    runs = bench.bench_summary(bench_records(spark, sf)).where("type = 'all'").select(
        F.col("mode").alias("model"), "mrr", F.lit(0.5).alias("macro_f1")
    )
    return bench.choose_model(runs, "hybrid")


_CONTENT = f"list_filter({word_set_sql('b.text')}, lambda w: w NOT IN {FUNCTIONS} AND w <> 'report')"
view("leaks", f"""
  SELECT p.query_id, coalesce(len(list_filter({_CONTENT}, lambda w: list_contains({word_set_sql('d.text')}, w)))::DOUBLE
    / nullif(len({_CONTENT}), 0), 0) AS overlap
  FROM {{past_work}} p JOIN benchmark b ON 'Q-' || b.item_id = p.query_id
  JOIN documents d ON printf('REQ-%04d', d.doc_id) = p.record_id""".replace("{{", "{").replace("}}", "}"))


@query("leakage_stats", "SELECT round(avg(overlap), 6) AS mean_overlap, count(*) FILTER (overlap > 0.2)::BIGINT AS over_limit,"
       " count(*)::BIGINT AS n FROM {leaks}")
def leakage_stats(spark, sf):
    passages = source(spark, sf, "benchmark").selectExpr("concat('Q-', item_id) AS query_id", "text AS asked")
    texts = source(spark, sf, "documents").selectExpr("format_string('REQ-%04d', doc_id) AS record_id", "text")
    pairs = past_work(spark, sf).join(passages, "query_id").join(texts, "record_id")
    overlap = content_overlap(F.col("asked"), F.col("text"), words_array(["report"]))
    return bench.leakage_stats(pairs.select(overlap.alias("overlap"))).select(
        *r6("mean_overlap"), "over_limit", "n"
    )


@query("before_after", """
SELECT mode, type, round(b.recall_1, 6) AS recall_1_before, round(b.recall_5, 6) AS recall_5_before,
  round(b.mrr, 6) AS mrr_before, round(a.recall_1, 6) AS recall_1_after, round(a.recall_5, 6) AS recall_5_after,
  round(a.mrr, 6) AS mrr_after, round(a.recall_1 - b.recall_1, 6) + 0.0::DOUBLE AS recall_1_change,
  round(a.recall_5 - b.recall_5, 6) + 0.0::DOUBLE AS recall_5_change, round(a.mrr - b.mrr, 6) + 0.0::DOUBLE AS mrr_change
FROM {bench_summary} a FULL JOIN (
  SELECT mode, coalesce(type, 'all') AS type, avg(coalesce(other_rank <= 1, false)::INT) AS recall_1,
    avg(coalesce(other_rank <= 5, false)::INT) AS recall_5, avg(coalesce(1.0 / other_rank, 0)) AS mrr
  FROM {bench_records} WHERE type <> 'N' GROUP BY GROUPING SETS ((mode, type), (mode))) b USING (mode, type)""")
def before_after(spark, sf):
    records = bench_records(spark, sf)
    swapped = records.withColumns(
        {"target_rank": F.col("other_rank"), "other_rank": F.col("target_rank")}
    )
    found = bench.before_after(bench.bench_summary(swapped), bench.bench_summary(records))
    names = [f"{m}_{w}" for w in ("before", "after", "change") for m in ("recall_1", "recall_5", "mrr")]
    return found.select("mode", "type", *r6(*names))


