import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylight.config import BM25_B, BM25_K1
from quarrylight.functions.vectors import hash_embed
from quarrylight.operators import bench, dense, search
from quarrylight.operators.bm25 import (
    block_bounds, block_of, bm25_scores, build_index, query_terms, rank_bm25, ranked_rounds,
)

DOC = "doc_id string, kind string, bm25_text string, dense_text string, department string, status string, exact_names array<string>"
QUERY = "query_id string, text string, kinds array<string>, department string, include_deprecated boolean, top_k int"


def docs(spark, texts):
    rows = [(i, k, t, t, d, s, n) for i, k, t, d, s, n in texts]
    return spark.createDataFrame(rows, DOC)


def plain(spark, *texts):
    return docs(spark, [(f"d{i}", "report", t, None, None, []) for i, t in enumerate(texts)])


def ask(spark, text, kinds=None, department=None, include=True, k=5):
    return spark.createDataFrame([("q", text, kinds, department, include, k)], QUERY)


def test_bm25_of_one_word_documents(spark):
    index = build_index(plain(spark, "alpha", "beta", "gamma"))
    row = bm25_scores(ask(spark, "alpha"), index).first()
    assert row["doc_id"] == "d0"
    assert row["score"] == pytest.approx(math.log(2.5 / 1.5), abs=1e-8)
    twice = bm25_scores(ask(spark, "alpha alpha"), index).first()
    assert twice["score"] == pytest.approx(2 * math.log(2.5 / 1.5), abs=1e-8)


def test_frequent_words_get_the_floor(spark):
    index = build_index(plain(spark, "a1 x", "a1 y", "a1 z"))
    idf = {r["token"]: r["idf"] for r in index.terms.collect()}
    rare, common = math.log(2.5 / 1.5), math.log(0.5 / 3.5)
    assert idf["x"] == pytest.approx(rare)
    assert idf["a1"] == pytest.approx(0.25 * (3 * rare + common) / 4)


def test_rows_of_one_id_count_together_and_as_often_as_they_come(spark):
    index = build_index(docs(spark, [
        ("d0", "report", "alpha beta", None, None, []), ("d0", "report", "alpha beta", None, None, []),
        ("d1", "report", "beta", None, None, []), ("d2", "report", "", None, None, []),
    ]))
    assert sorted((r["doc_id"], r["dl"]) for r in index.docs.collect()) == [("d0", 4), ("d0", 4), ("d1", 1), ("d2", 0)]
    assert sorted((r["token"], r["df"]) for r in index.terms.collect()) == [("alpha", 1), ("beta", 2)]
    weight = math.log(3.5 / 1.5) * 2 * (BM25_K1 + 1) / (2 + BM25_K1 * (1 - BM25_B + BM25_B * 4 / (9 / 4)))
    assert bm25_scores(ask(spark, "alpha"), index).first()["score"] == pytest.approx(2 * weight, abs=1e-8)
    assert rank_bm25(ask(spark, "alpha"), index, 3).first()["score"] == pytest.approx(2 * weight, abs=1e-8)


def test_only_asked_postings_are_met_and_they_are_not_shuffled(spark):
    index = build_index(many_docs(spark))
    asked = index.postings_of(query_terms(ask(spark, "w1 w3 absent")))
    assert {r["token"] for r in asked.select("token").distinct().collect()} == {"w1", "w3"}
    assert "Exchange hashpartitioning" not in asked._jdf.queryExecution().executedPlan().toString()


def test_texts_are_dealt_out_once_to_be_embedded(spark):
    frame = plain(spark, "alpha beta", "", "gamma").unionByName(plain(spark, "beta"))
    embedded = hash_embed(frame, "doc_id", "dense_text")
    assert embedded._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    merged = hash_embed(plain(spark, "alpha beta beta", "", "gamma"), "doc_id", "dense_text")
    assert sorted(embedded.collect()) == sorted(merged.collect())


def test_ties_go_to_the_lower_id_and_blocks_change_nothing(spark):
    frame = plain(spark, *["same words here"] * 6, "other")
    whole = rank_bm25(ask(spark, "same"), build_index(frame), 4).orderBy("rank").collect()
    split = rank_bm25(ask(spark, "same"), build_index(frame, block_docs=2), 4).orderBy("rank").collect()
    assert [r["doc_id"] for r in whole] == ["d0", "d1", "d2", "d3"]
    assert whole == split


def many_docs(spark, n=400):
    """Zipf words, lengths of 1 to 60, kinds and departments; equal texts, so that scores tie."""
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(150)]
    weights = [1 / (k + 1) for k in range(150)]
    rows = []
    for i in range(n):
        text = " ".join(rnd.choices(words, weights, k=rnd.randint(1, 60))) if i % 5 else "w3 w40 w90"
        rows.append((f"d{i:04d}", ("report", "table", "metric")[i % 3], text, "ab"[i % 2], ("deprecated", None)[i % 4 > 0], []))
    return docs(spark, rows)


def many_queries(spark, n):
    rnd = random.Random(9)
    rows = [
        (f"q{i}", " ".join(f"w{int(150 * rnd.random() ** 2)}" for _ in range(rnd.randint(1, 6))),
         ["report"] if i % 4 == 0 else None, "a" if i % 5 == 0 else None, i % 3 > 0, 5)
        for i in range(n)
    ] + [("none", "absent words", None, None, True, 5), ("rare", "w149 w148 w3", None, None, True, 5)]
    return spark.createDataFrame(rows, QUERY)


def ranked_from_all_scores(queries, index, n):
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = bm25_scores(queries, index).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in ranked.collect())


@pytest.mark.parametrize("block_docs,first,n", [(10, 2, 5), (10, 1, 50), (1000, 2, 5), (3, 3, 1)])
def test_ranking_by_blocks_equals_ranking_all_scores(spark, block_docs, first, n):
    index, queries = build_index(many_docs(spark), block_docs=block_docs), many_queries(spark, 60)
    got = sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in rank_bm25(queries, index, n, first).collect())
    assert got == ranked_from_all_scores(queries, index, n)


def test_blocks_below_the_nth_score_are_not_read(spark):
    """Thousands of queries: a (query, block) hands on n rows at most, and most blocks are skipped."""
    index, queries, n = build_index(many_docs(spark), block_docs=10), many_queries(spark, 3000), 3
    first, rest = ranked_rounds(queries, index, n, 2)
    both = first.unionByName(rest)
    assert both.groupBy("query_id", "block").count().agg(F.max("count")).first()[0] <= n
    bounds = block_bounds(query_terms(queries), index)
    scored = bm25_scores(queries, index).join(block_of(index.docs, 10).select("doc_id", "block"), "doc_id")
    highest = scored.groupBy("query_id", "block").agg(F.max("score").alias("highest"))
    assert highest.join(bounds, ["query_id", "block"]).where("highest > bound").count() == 0
    assert both.select("query_id", "block").distinct().count() * 4 < bounds.count() * 3


@pytest.mark.parametrize("lists,expected", [
    ((["A", "B", "C"], ["B", "D", "A"]), ["B", "A", "D", "C"]), ((["Z", "A"], ["A", "Z"]), ["A", "Z"]),
])
def test_rrf(spark, lists, expected):
    rows = [("q", name, d, r) for name, ranked in zip(("bm25", "dense"), lists) for r, d in enumerate(ranked, 1)]
    fused = search.rrf_fuse(spark.createDataFrame(rows, "query_id string, list string, doc_id string, rank int"))
    assert [r["doc_id"] for r in fused.orderBy("rank").collect()] == expected


def vectors(spark, n, dim, seed):
    rng = np.random.default_rng(seed)
    raw = rng.normal(size=(n, dim))
    raw /= np.linalg.norm(raw, axis=1, keepdims=True)
    kinds = [["report", "table"][i % 2] for i in range(n)]
    rows = [(f"d{i:03d}", raw[i].tolist(), kinds[i], None, "deprecated" if i % 7 == 0 else None) for i in range(n)]
    return raw, kinds, spark.createDataFrame(
        rows, "doc_id string, embedding array<double>, kind string, department string, status string")


@pytest.mark.parametrize("limit", [4096, 3])
def test_dense_matches_numpy_in_both_shapes(spark, monkeypatch, limit):
    monkeypatch.setattr(dense, "BROADCAST_QUERIES", limit)
    monkeypatch.setattr(dense, "BLOCK_DOCS", 40)
    raw, kinds, frame = vectors(spark, 150, 8, 1)
    questions, _, _ = vectors(spark, 10, 8, 2)
    rows = [(f"q{j}", questions[j].tolist(), ["table"] if j % 2 else None, None, j % 3 != 0) for j in range(10)]
    queries = spark.createDataFrame(
        rows, "query_id string, embedding array<double>, kinds array<string>, department string, include_deprecated boolean")
    partials = dense.dense_partials(queries, frame, 5).cache()
    got = {}
    for r in dense.rank_dense(partials, 5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["doc_id"]
    background = {r["query_id"]: r for r in dense.dense_background(partials).collect()}
    for j in range(10):
        keep = [i for i in range(150)
                if (j % 2 == 0 or kinds[i] == "table") and (j % 3 != 0 or i % 7 != 0)]
        cosines = np.round(raw[keep] @ questions[j], 9)
        order = sorted(range(len(keep)), key=lambda p: (-cosines[p], keep[p]))[:5]
        assert [got[f"q{j}"][r] for r in range(1, 6)] == [f"d{keep[p]:03d}" for p in order]
        row = background[f"q{j}"]
        assert row["n"] == len(keep)
        assert row["dense_z"] == pytest.approx((cosines.max() - cosines.mean()) / cosines.std(), abs=1e-6)


FIVE = [
    ("RPT-0001", "report", "Dealer margin by region", "Sales", "active", ["Dealer margin"]),
    ("RPT-0002", "report", "Dealer margin old", "Sales", "deprecated", ["Dealer margin old"]),
    ("TBL-001", "table", "fct_sales dealer", "Finance", None, ["fct_sales"]),
    ("MET-001", "metric", "Gross margin GM%", "Finance", None, ["Gross margin", "GM%"]),
    ("TBL-002", "table", "dim_region", "Finance", None, ["dim_region"]),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return search.build_corpus(docs(spark, FIVE))


def test_filters_apply_before_ranking(spark, corpus):
    found = search.search(ask(spark, "dealer margin", ["report"], "Sales", False), corpus)
    assert [r["doc_id"] for r in found.hits.collect()] == ["RPT-0001"]


@pytest.mark.parametrize("text,exact", [
    ("show fct sales now", True), ("what is rpt-0002", True), ("gross margins", False), ("what is tbl-999", False),
])
def test_exact_match(spark, corpus, text, exact):
    signal = search.search(ask(spark, text), corpus).signal.first()
    assert signal["exact_match"] is exact
    if exact:
        assert signal["match_quality"] == "strong"


def test_empty_corpus_is_weak(spark, corpus):
    found = search.search(ask(spark, "dealer", None, "Nowhere"), corpus)
    row = found.signal.first()
    assert found.hits.count() == 0
    assert (row["match_quality"], row["top_cosine"], row["dense_z"]) == ("weak", 0.0, 0.0)


def test_modes_share_the_signal(spark, corpus):
    found = search.search_all_modes(ask(spark, "dealer margin region"), corpus)
    assert {r["mode"] for r in found.hits.collect()} == {"bm25", "dense", "hybrid"}
    with pytest.raises(ValueError):
        search.search(ask(spark, "x"), corpus, mode="fuzzy")


def test_no_spread_gives_zero_z(spark):
    rows = [("q", "d1", 0.5, None, None, None), ("q", None, None, 1, 0.5, 0.25)]
    partials = spark.createDataFrame(
        rows, "query_id string, doc_id string, cosine double, n long, total double, squares double")
    assert dense.dense_background(partials).first()["dense_z"] == 0.0


def test_threshold_choice(spark):
    records = spark.createDataFrame(
        [(True, False, 0.9), (True, False, 0.8), (False, False, 0.2), (False, False, 0.4)],
        "truth boolean, exact_match boolean, v double")
    sweep = bench.threshold_sweep(records, "v", [0.1, 0.3, 0.5, 0.6, 0.7, 0.95])
    got = {r["tau"]: round(r["macro_f1"], 4) for r in sweep.collect()}
    assert got[0.5] == 1.0 and got[0.7] == 1.0 and got[0.1] == pytest.approx(0.3333)
    best = bench.choose_tau(sweep).first()
    assert (best["tau"], best["macro_f1"]) == (0.6, 1.0)


@pytest.mark.parametrize("runs,expected", [
    ([("a", 0.50, 0.9), ("b", 0.53, 0.1)], "b"), ([("a", 0.50, 0.70), ("b", 0.51, 0.71)], "b"),
    ([("a", 0.50, 0.70), ("b", 0.51, 0.702)], "a"), ([("z", 0.5, 0.7), ("a", 0.5, 0.7)], "z"),
])
def test_model_choice(spark, runs, expected):
    frame = spark.createDataFrame(runs, "model string, mrr double, macro_f1 double")
    incumbent = "z" if any(r[0] == "z" for r in runs) else "a"
    assert bench.choose_model(frame, incumbent).first()["model"] == expected


def test_search_plan_has_no_pairwise_join(spark, corpus):
    scored = bm25_scores(ask(spark, "dealer"), corpus.index)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_names_are_matched_on_word_borders(spark, corpus):
    hit = search.name_in_query(ask(spark, "the dealer margin older"), corpus.names)
    assert {r["doc_id"] for r in hit.collect()} == {"RPT-0001"}


def test_vectors_of_one_table_meet_each_other_in_blocks(spark, monkeypatch):
    """Queries and documents from one table, beyond the size that is handed out."""
    monkeypatch.setattr(dense, "BROADCAST_QUERIES", 30)
    monkeypatch.setattr(dense, "BLOCK_DOCS", 40)
    raw, _, frame = vectors(spark, 100, 8, 3)
    queries = frame.selectExpr(
        "doc_id AS query_id", "embedding", "cast(NULL AS array<string>) AS kinds", "department", "true AS include_deprecated")
    found = dense.rank_dense(dense.dense_partials(queries, frame, 4, skip_self=True), 4).collect()
    cosines = np.round(raw @ raw.T, 9)
    expected = {(f"d{q:03d}", rank, f"d{d:03d}") for q in range(100) for rank, d in enumerate(
        sorted((d for d in range(100) if d != q), key=lambda d: (-cosines[q, d], d))[:4], 1)}
    assert {(r["query_id"], r["rank"], r["doc_id"]) for r in found} == expected


def test_a_block_holds_few_cosines_at_a_time(spark, monkeypatch):
    _, _, frame = vectors(spark, 50, 8, 4)
    some = frame.toPandas()
    asked = some.rename(columns={"doc_id": "query_id"}).assign(kinds=None, include_deprecated=True)
    whole = list(dense._block(some, asked, 3, True))
    monkeypatch.setattr(dense, "CELL_COSINES", 120)
    sliced = list(dense._block(some, asked, 3, True))
    assert len(whole) == 2 and len(sliced) == 50
    for part in (0, 1):
        both = [[tuple(r) for r in df[["query_id", "doc_id"]].itertuples(index=False)] for df in sliced[part::2]]
        assert sum(both, []) == [tuple(r) for r in whole[part][["query_id", "doc_id"]].itertuples(index=False)]


def test_parts_of_a_corpus_are_built_when_asked_for(spark, monkeypatch):
    written = []
    whole = search.stage
    monkeypatch.setattr(search, "stage", lambda df, name: written.append(name) or whole(df, name))
    corpus = search.build_corpus(docs(spark, FIVE))
    assert search.name_in_query(ask(spark, "the dealer margin"), corpus.names).count() == 1
    assert written == ["docs", "names"]
    assert search.search_all_modes(ask(spark, "dealer margin"), corpus).signal.first()["exact_match"]
    assert written == ["docs", "names", "vectors", "dense"] and "index" not in vars(corpus)
