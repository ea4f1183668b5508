"""Queries over the search corpora: index, ranks, fusion, signal and the search tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions.text import is_distinctive, normalize_padded, tokenize
from quarrylight.functions.vectors import hash_embed
from quarrylight.operators import bm25, corpus, dense, search, tools
from quarrylight.plans import search_views  # noqa: F401  (defines the SQL views)
from quarrylight.plans.bindings import catalog, source
from quarrylight.plans.registry import query
from quarrylight.plans.search_views import norm_sql, tokens_sql


def _prepared(cat, key, build):
    if key not in cat.prepared:
        cat.prepared[key] = build()
    return cat.prepared[key]


def asset_corpus(spark, sf) -> search.Corpus:
    cat = catalog(spark, sf)
    return _prepared(cat, "asset_corpus", lambda: search.build_corpus(corpus.asset_documents(cat)))


def request_corpus(spark, sf) -> search.Corpus:
    cat = catalog(spark, sf)
    return _prepared(
        cat, "request_corpus", lambda: search.build_corpus(corpus.request_documents(cat))
    )


def asset_queries(spark, sf):
    """One query per brand: some name a table, some give its ID, some do neither."""
    brands = (
        source(spark, sf, "part")
        .groupBy(F.expr("cast(substring(p_brand, 7) as int)").alias("b"))
        .agg(F.min("p_partkey").alias("k"), F.min_by("p_name", "p_partkey").alias("first_name"))
    )
    return brands.selectExpr(
        "concat('Q-', b) AS query_id",
        "concat('who owns ', CASE b % 3"
        " WHEN 0 THEN concat(element_at(array('stg ', 'int ', 'dim '), cast(k % 3 + 1 as int)),"
        " first_name, ' ', k)"
        " WHEN 1 THEN concat(format_string('tbl-%04d', k), ' ', first_name)"
        " ELSE concat(first_name, ' view') END, ' of brand ', b) AS text",
        "CASE b % 4 WHEN 1 THEN array('table') WHEN 2 THEN array('report', 'metric')"
        " WHEN 3 THEN array('table', 'report', 'metric') END AS kinds",
        "CASE WHEN b % 2 = 1 THEN 'BUILDING' END AS department",
        "b % 3 <> 0 AS include_deprecated",
        "5 + b % 6 AS top_k",
    )


def request_queries(spark, sf):
    """Every benchmark passage as a question for past work."""
    return source(spark, sf, "benchmark").selectExpr(
        "concat('Q-', item_id) AS query_id", "text", "cast(NULL as array<string>) AS kinds",
        "CASE WHEN item_id % 2 = 1 THEN 'en' END AS department", "true AS include_deprecated",
        "5 AS top_k",
    )


def all_modes(spark, sf, which: str) -> search.SearchResult:
    """The finished search of one corpus in all modes, run once per session."""
    queries, corpus_of = {
        "asset": (asset_queries, asset_corpus), "request": (request_queries, request_corpus)
    }[which]
    return _prepared(
        catalog(spark, sf), f"{which}_results",
        lambda: search.search_all_modes(queries(spark, sf), corpus_of(spark, sf)),
    )


def results(spark, sf, which: str, mode: str = "hybrid") -> search.SearchResult:
    return all_modes(spark, sf, which).of_mode(mode)


@query("tokenize", f"""
SELECT doc_id, array_to_string({tokens_sql("text")}, ' ') AS tokens FROM documents""")
def tokens(spark, sf):
    return source(spark, sf, "documents").select(
        "doc_id", F.array_join(tokenize(F.col("text")), " ").alias("tokens")
    )


@query("normalize_padded", f"SELECT doc_id, {norm_sql('text')} AS words FROM documents")
def normalized(spark, sf):
    return source(spark, sf, "documents").select(
        "doc_id", normalize_padded(F.col("text")).alias("words")
    )


@query("is_distinctive_alias", """
SELECT a AS alias, regexp_matches(a, '^[A-Z0-9%&]{2,}$')
  OR len(regexp_extract_all(lower(a), '[a-z0-9]+')) >= 2 AS is_distinctive
FROM (SELECT unnest(string_split(aliases, '|')) AS a FROM {metrics}) x""")
def distinctive(spark, sf):
    aliases = catalog(spark, sf).metrics.select(F.explode(F.split("aliases", r"\|")).alias("alias"))
    return aliases.select("alias", is_distinctive(F.col("alias")).alias("is_distinctive"))


def _text_query(name: str, view_name: str, kind: str, column: str, build):
    @query(name, f"SELECT doc_id, {column} AS text FROM {{{view_name}}} WHERE kind = '{kind}'")
    def run(spark, sf):
        return build(catalog(spark, sf)).select("doc_id", F.col(column).alias("text"))


_text_query("bm25_text_report", "asset_docs", "report", "bm25_text", corpus.report_documents)
_text_query("bm25_text_table", "asset_docs", "table", "bm25_text", corpus.table_documents)
_text_query("bm25_text_metric", "asset_docs", "metric", "bm25_text", corpus.metric_documents)
_text_query("bm25_text_request", "request_docs", "request", "bm25_text", corpus.request_documents)


@query("dense_text", """
SELECT doc_id, dense_text FROM {asset_docs} UNION ALL SELECT doc_id, dense_text FROM {request_docs}""")
def dense_text(spark, sf):
    cat = catalog(spark, sf)
    return corpus.asset_documents(cat).union(corpus.request_documents(cat)).select(
        "doc_id", "dense_text"
    )


_CORPUS = """SELECT doc_id, kind, bm25_text, dense_text, department, status,
  array_to_string(exact_names, '|') AS exact_names FROM {%s}"""


@query("asset_corpus", _CORPUS % "asset_docs")
def asset_docs(spark, sf):
    return asset_corpus(spark, sf).docs.withColumn("exact_names", F.array_join("exact_names", "|"))


@query("request_corpus", _CORPUS % "request_docs")
def request_docs(spark, sf):
    return request_corpus(spark, sf).docs.withColumn("exact_names", F.array_join("exact_names", "|"))


@query("corpus_mask", """
SELECT q.query_id, d.kind, count(*)::BIGINT AS documents FROM {asset_queries} q JOIN {asset_docs} d
  ON (q.kinds IS NULL OR list_contains(q.kinds, d.kind))
  AND (q.department IS NULL OR q.department = d.department)
  AND (q.include_deprecated OR d.status IS DISTINCT FROM 'deprecated') GROUP BY ALL""")
def corpus_mask(spark, sf):
    # Documents are counted per filter value first; only those few groups meet the queries.
    groups = asset_corpus(spark, sf).docs.groupBy("kind", "department", "status").agg(
        F.count("*").alias("n")
    )
    asked = asset_queries(spark, sf).withColumn(
        "kind", F.explode(F.coalesce("kinds", F.array(*[F.lit(k) for k in tools.ASSET_KINDS])))
    )
    met = asked.alias("q").join(groups.alias("d"), F.col("q.kind") == F.col("d.kind"))
    return met.where(bm25.allowed("q", "d")).groupBy("query_id", F.col("d.kind").alias("kind")).agg(
        F.sum("n").alias("documents")
    )


@query("bm25_index", """
SELECT i.token, i.df::BIGINT AS df, round(i.idf, 6) AS idf, sum(f.tf)::BIGINT AS occurrences
FROM {rr_idf} i JOIN {rr_tf} f USING (token) GROUP BY ALL""")
def bm25_index(spark, sf):
    index = request_corpus(spark, sf).index
    totals = index.postings.groupBy("token").agg(F.sum(F.col("tf") * F.col("copies")).alias("occurrences"))
    return index.terms.join(totals, "token").select(
        "token", "df", F.round("idf", 6).alias("idf"), "occurrences"
    )


@query("bm25_score", "SELECT query_id, doc_id, score FROM {rr_bm25}")
def bm25_score(spark, sf):
    found = bm25.bm25_scores(request_queries(spark, sf), request_corpus(spark, sf).index)
    return found.select("query_id", "doc_id", "score")


@query("bm25_match", "SELECT query_id, count(*)::BIGINT AS documents FROM {ra_bm25} GROUP BY 1")
def bm25_match(spark, sf):
    found = bm25.bm25_scores(asset_queries(spark, sf), asset_corpus(spark, sf).index)
    return found.groupBy("query_id").agg(F.count("*").alias("documents"))


@query("rank_bm25", """
SELECT query_id, doc_id, score, rank::BIGINT AS rank FROM {ra_rank_bm25}""")
def rank_bm25(spark, sf):
    ranked = bm25.rank_bm25(asset_queries(spark, sf), asset_corpus(spark, sf).index)
    return ranked.select(
        "query_id", "doc_id", "score", F.col("rank").cast("bigint")
    )


@query("hash_embed", """
SELECT doc_id, count(*)::BIGINT AS nonzero, round(sum(v * (bucket + 1)), 6) + 0.0::DOUBLE AS weighted_sum
FROM {rr_emb} GROUP BY 1""")
def hash_embedding(spark, sf):
    vectors = hash_embed(request_corpus(spark, sf).docs, "doc_id", "dense_text")
    spread = vectors.select("doc_id", F.posexplode("embedding").alias("bucket", "v")).where("v <> 0")
    return spread.groupBy("doc_id").agg(
        F.count("*").alias("nonzero"),
        F.round(F.sum(F.col("v") * (F.col("bucket") + 1)), 6).alias("weighted_sum"),
    )


def _partials(spark, sf):
    c = asset_corpus(spark, sf)
    return dense.dense_partials(search.embed_queries(asset_queries(spark, sf)), c.vectors)


@query("rank_dense", """
SELECT query_id, doc_id, cosine, rank::BIGINT AS rank FROM {ra_rank_dense}""")
def rank_dense(spark, sf):
    return dense.rank_dense(_partials(spark, sf)).select(
        "query_id", "doc_id", "cosine", F.col("rank").cast("bigint")
    )


def vector_corpus(spark, sf):
    """Stored embeddings as documents (kind = topic) and as queries, half of them by topic."""
    vectors = source(spark, sf, "embeddings").selectExpr(
        "format_string('VEC-%05d', vec_id) AS doc_id", "embedding",
        "concat('topic', label) AS kind", "cast(NULL as string) AS department",
        "cast(NULL as string) AS status", "vec_id",
    )
    queries = vectors.selectExpr(
        "doc_id AS query_id", "embedding", "CASE WHEN vec_id % 2 = 0 THEN array(kind) END AS kinds",
        "department", "true AS include_deprecated",
    )
    return queries, vectors


_VECTORS = """
  SELECT printf('VEC-%05d', vec_id) AS doc_id, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings"""
search_views.view("vectors", _VECTORS)
search_views.view("vcos", """
  SELECT q.doc_id AS query_id, d.doc_id, round(list_dot_product(q.e, d.e), 9) + 0.0::DOUBLE AS cosine
  FROM {vectors} q JOIN {vectors} d ON q.doc_id <> d.doc_id
    AND (q.vec_id % 2 = 1 OR q.label = d.label)""")
search_views.view("vrank", """
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id)
    AS rank FROM {vcos}) x WHERE rank <= 50""")


@query("dense_search", """
SELECT query_id, doc_id, cosine, rank::BIGINT AS rank FROM {vrank}""")
def dense_search(spark, sf):
    queries, vectors = vector_corpus(spark, sf)
    found = dense.rank_dense(dense.dense_partials(queries, vectors, skip_self=True))
    return found.select(
        "query_id", "doc_id", "cosine", F.col("rank").cast("bigint")
    )


@query("rrf_fuse", """
SELECT query_id, doc_id, round(score, 9) AS score, rank::BIGINT AS rank FROM {ra_fused}""")
def rrf_fuse(spark, sf):
    lists = bm25.rank_bm25(asset_queries(spark, sf), asset_corpus(spark, sf).index).select(
        "query_id", F.lit("bm25").alias("list"), "doc_id", "rank"
    ).union(
        dense.rank_dense(_partials(spark, sf)).select(
            "query_id", F.lit("dense").alias("list"), "doc_id", "rank"
        )
    )
    return search.rrf_fuse(lists).select(
        "query_id", "doc_id", F.round("score", 9).alias("score"), F.col("rank").cast("bigint")
    )


@query("name_in_query", f"""
SELECT q.query_id, d.doc_id FROM {{asset_queries}} q JOIN {{asset_docs}} d ON
  len(list_filter(d.exact_names, lambda n: trim({norm_sql("n")}) <> ''
    AND contains({norm_sql("q.text")}, {norm_sql("n")}))) > 0""".replace("{{", "{").replace("}}", "}"))
def name_in_query(spark, sf):
    return search.name_in_query(asset_queries(spark, sf), asset_corpus(spark, sf).names)


@query("exact_match_signal", "SELECT query_id FROM {ra_exact}")
def exact_match_signal(spark, sf):
    return search.exact_matches(asset_queries(spark, sf), asset_corpus(spark, sf))


@query("match_signal", """
SELECT query_id, exact_match, top_cosine, round(dense_z, 6) AS dense_z,
  match_quality FROM {ra_signal}""")
def match_signal(spark, sf):
    return results(spark, sf, "asset").signal.withColumn("dense_z", F.round("dense_z", 6))


_HITS = """
SELECT f.query_id, f.doc_id, f.rank::BIGINT AS rank, round(f.score, 9) AS score,
  f.bm25_rank::BIGINT AS bm25_rank, f.dense_rank::BIGINT AS dense_rank
FROM {%s_fused} f JOIN {%s_queries} q USING (query_id) WHERE f.rank <= q.top_k"""


def _hits(found):
    return found.hits.select(
        "query_id", "doc_id", F.col("rank").cast("bigint"), F.round("score", 9).alias("score"),
        F.col("bm25_rank").cast("bigint"), F.col("dense_rank").cast("bigint"),
    )


@query("search", _HITS % ("rr", "request"))
def hybrid_search(spark, sf):
    return _hits(results(spark, sf, "request"))


@query("topk_hits", _HITS % ("ra", "asset"))
def topk_hits(spark, sf):
    return _hits(results(spark, sf, "asset"))


search_views.view("asset_cards", """
  SELECT report_id AS id, 'report' AS type, name, department, status, replaced_by_report_id,
    CASE WHEN length(description) > 160 THEN substr(description, 1, 157) || '...'
      ELSE description END AS snippet FROM {reports}
  UNION ALL SELECT table_id, 'table', name, e.department, NULL, NULL,
    CASE WHEN length(t.description) > 160 THEN substr(t.description, 1, 157) || '...'
      ELSE t.description END FROM {tables} t JOIN {employees} e ON e.employee_id = t.owner_id
  UNION ALL SELECT metric_id, 'metric', name, e.department, NULL, NULL,
    CASE WHEN length(business_definition) > 160 THEN substr(business_definition, 1, 157) || '...'
      ELSE business_definition END FROM {metrics} m JOIN {employees} e ON e.employee_id = m.owner_id""")


@query("search_cards", """
SELECT f.query_id, c.*, f.rank::BIGINT AS rank FROM {ra_fused} f JOIN {asset_queries} q
  USING (query_id) JOIN {asset_cards} c ON c.id = f.doc_id WHERE f.rank <= q.top_k""")
def search_cards(spark, sf):
    cards = tools.search_cards(catalog(spark, sf), results(spark, sf, "asset").hits)
    return cards.withColumn("rank", F.col("rank").cast("bigint"))


@query("search_assets", """
SELECT q.query_id, s.match_quality, s.exact_match, count(c.id)::BIGINT AS hits,
  string_agg(c.type || ' ' || c.id, ',' ORDER BY f.rank) AS cards
FROM {asset_queries} q JOIN {ra_signal} s USING (query_id)
LEFT JOIN {ra_fused} f ON f.query_id = q.query_id AND f.rank <= q.top_k
LEFT JOIN {asset_cards} c ON c.id = f.doc_id GROUP BY ALL""")
def search_assets(spark, sf):
    cat = catalog(spark, sf)
    found = results(spark, sf, "asset")
    cards = tools.search_cards(cat, found.hits)
    listed = cards.groupBy("query_id").agg(
        F.count("*").alias("hits"),
        F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", "type", "id").alias("card"))))
        .alias("ranked"),
    )
    return found.signal.join(listed, "query_id", "left").select(
        "query_id", "match_quality", "exact_match", F.coalesce("hits", F.lit(0)).alias("hits"),
        F.array_join(F.transform("ranked", lambda r: r["card"]), ",").alias("cards"),
    )


@query("find_similar_past_work", """
SELECT f.query_id, f.doc_id AS request_id, r.title, r.status, r.created_date, r.closed_date,
  r.resulting_report_id, r.duplicate_of_request_id, f.rank::BIGINT AS rank, s.match_quality
FROM {rr_fused} f JOIN {request_queries} q USING (query_id) JOIN {requests} r
  ON r.request_id = f.doc_id JOIN {rr_signal} s ON s.query_id = f.query_id
WHERE f.rank <= q.top_k""")
def find_similar_past_work(spark, sf):
    cat = catalog(spark, sf)
    found = results(spark, sf, "request")
    work = cat.requests.select(
        F.col("request_id").alias("doc_id"), "title", "status", "created_date", "closed_date",
        "resulting_report_id", "duplicate_of_request_id",
    )
    return found.hits.join(work, "doc_id").join(
        found.signal.select("query_id", "match_quality"), "query_id"
    ).select(
        "query_id", F.col("doc_id").alias("request_id"), "title", "status", "created_date",
        "closed_date", "resulting_report_id", "duplicate_of_request_id",
        F.col("rank").cast("bigint").alias("rank"), "match_quality",
    )
