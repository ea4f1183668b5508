"""Hybrid search for a table of queries: lexical and dense ranks fused, with a match signal."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.config import RRF_CANDIDATES, RRF_K, TAU, TAU_Z
from quarrylight.functions.text import ascii_words, record_ids
from quarrylight.functions.vectors import hash_embed
from quarrylight.operators.bm25 import Bm25Index, allowed, build_index, rank_bm25
from quarrylight.operators.dense import dense_background, dense_partials, rank_dense
from quarrylight.sources.staging import stage


@dataclass
class Corpus:
    """A searchable corpus: its documents, and their inverted index, vectors and exact names, each
    built and written the first time it is asked for."""

    docs: DataFrame

    @cached_property
    def index(self) -> Bm25Index:
        return build_index(self.docs)

    @cached_property
    def vectors(self) -> DataFrame:
        embedded = hash_embed(self.docs, "doc_id", "dense_text")
        filters = self.docs.select("doc_id", "kind", "department", "status")
        return stage(filters.join(embedded, "doc_id"), "vectors")

    @cached_property
    def names(self) -> DataFrame:
        return stage(exact_names(self.docs), "names")


def exact_names(docs: DataFrame) -> DataFrame:
    """name_key (words joined by blanks), n_words and the document it names."""
    words = docs.select(
        "doc_id", "kind", "department", "status", F.explode("exact_names").alias("name")
    ).withColumn("words", ascii_words(F.col("name")))
    return words.where(F.size("words") > 0).select(
        "doc_id", "kind", "department", "status",
        F.array_join("words", " ").alias("name_key"), F.size("words").alias("n_words"),
    )


def build_corpus(docs: DataFrame) -> Corpus:
    """The documents, written once; what a search needs of them is written when it is first needed."""
    return Corpus(stage(docs, "docs"))


def name_in_query(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, doc_id) where the query holds a document's name on word borders.

    The words of a query are cut into every run as long as some name, and the runs are joined to
    the names; nothing is compared pairwise.
    """
    lengths = names.agg(F.collect_set("n_words")).scalar()
    words = queries.select("query_id", ascii_words(F.col("text")).alias("words")).withColumn(
        "n_words", F.explode(lengths)
    )
    runs = (
        words.where(F.col("n_words") <= F.size("words"))
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n_words") + 1)))
        .select(
            "query_id",
            F.array_join(F.slice("words", F.col("at"), F.col("n_words")), " ").alias("name_key"),
        )
        .distinct()
    )
    return runs.join(names, "name_key").select("query_id", "doc_id").distinct()


def exact_matches(queries: DataFrame, corpus: Corpus) -> DataFrame:
    """query_id of queries that name an allowed document by its ID or its full name."""
    filters = queries.select("query_id", "kinds", "department", "include_deprecated").alias("q")
    named_ids = queries.select(
        "query_id", F.explode(record_ids(F.upper("text"))).alias("doc_id")
    )
    found = named_ids.union(name_in_query(queries, corpus.names)).distinct()
    docs = corpus.docs.select("doc_id", "kind", "department", "status")
    hits = found.join(docs, "doc_id").alias("d").join(
        filters, (F.col("q.query_id") == F.col("d.query_id")) & allowed("q", "d")
    )
    return hits.select("q.query_id").distinct()


def rrf_fuse(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """rankings(query_id, list, doc_id, rank) -> score and rank per document.

    A document missing from a list gets nothing from it; ties go to the lower ID.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return (
        rankings.groupBy("query_id", "doc_id")
        .agg(
            F.sum(F.when(F.col("list") == "bm25", F.lit(1.0) / (F.lit(k) + F.col("rank")))).alias("b"),
            F.sum(F.when(F.col("list") == "dense", F.lit(1.0) / (F.lit(k) + F.col("rank")))).alias("d"),
            F.max(F.when(F.col("list") == "bm25", F.col("rank"))).alias("bm25_rank"),
            F.max(F.when(F.col("list") == "dense", F.col("rank"))).alias("dense_rank"),
        )
        .select(
            "query_id", "doc_id",
            (F.coalesce("b", F.lit(0.0)) + F.coalesce("d", F.lit(0.0))).alias("score"),
            "bm25_rank", "dense_rank",
        )
        .withColumn("rank", F.row_number().over(order))
    )


def match_signal(
    queries: DataFrame,
    partials: DataFrame,
    exact: DataFrame,
    kind: str = "z",
    tau: float = TAU,
    tau_z: float = TAU_Z,
) -> DataFrame:
    """Per query: exact_match, top_cosine, dense_z and match_quality (strong or weak).

    A query whose filters leave no document is weak with zeros.
    """
    background = dense_background(partials)
    named = exact.withColumn("exact_match", F.lit(True))
    stands_out = F.col("top_cosine") >= tau if kind == "cosine" else F.col("dense_z") >= tau_z
    return (
        queries.select("query_id").join(background, "query_id", "left")
        .join(named, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("exact_match", F.lit(False)).alias("exact_match"),
            F.coalesce("top_cosine", F.lit(0.0)).alias("top_cosine"),
            F.coalesce("dense_z", F.lit(0.0)).alias("dense_z"),
        )
        .withColumn(
            "match_quality", F.when(F.col("exact_match") | stands_out, "strong").otherwise("weak")
        )
    )


@dataclass
class SearchResult:
    """hits(query_id, doc_id, rank, score, bm25_rank, dense_rank) and one signal per query.

    Both are made when first asked for: the signal needs no lexical ranks.
    """

    find: Callable[[], DataFrame]
    weigh: Callable[[], DataFrame]

    @cached_property
    def hits(self) -> DataFrame:
        return self.find()

    @cached_property
    def signal(self) -> DataFrame:
        return self.weigh()

    def of_mode(self, mode: str) -> SearchResult:
        """The hits of one mode; the signal is the same in every mode."""
        return SearchResult(lambda: self.hits.where(F.col("mode") == mode).drop("mode"), lambda: self.signal)


def embed_queries(queries: DataFrame) -> DataFrame:
    return queries.join(hash_embed(queries, "query_id", "text"), "query_id")


def ranked_lists(queries: DataFrame, corpus: Corpus, partials: DataFrame, n: int) -> DataFrame:
    """(query_id, list, doc_id, rank, score): the lexical and the dense candidates."""
    lexical = rank_bm25(queries, corpus.index, n)
    vectors = rank_dense(partials, n)
    return lexical.select("query_id", F.lit("bm25").alias("list"), "doc_id", "rank", "score").union(
        vectors.select("query_id", F.lit("dense").alias("list"), "doc_id", "rank",
                       F.col("cosine").alias("score"))
    )


def search_all_modes(
    queries: DataFrame, corpus: Corpus, n_candidates: int = RRF_CANDIDATES, signal: str = "z"
) -> SearchResult:
    """Hits of all three modes with a `mode` column; candidates are found once and shared.

    queries(query_id, text, kinds, department, include_deprecated, top_k). Filters apply before
    any ranking. The signal is the same in every mode.
    """
    queries = queries.where(F.trim("text") != "")
    partials = stage(dense_partials(embed_queries(queries), corpus.vectors, n_candidates), "dense")

    def hits() -> DataFrame:
        lists = stage(ranked_lists(queries, corpus, partials, n_candidates), "lists")
        fused = stage(rrf_fuse(lists), "fused")
        single = lists.join(fused.drop("score", "rank"), ["query_id", "doc_id"]).select(
            F.col("list").alias("mode"), "query_id", "doc_id", "rank", "score", "bm25_rank", "dense_rank"
        )
        both = fused.select(
            F.lit("hybrid").alias("mode"), "query_id", "doc_id", "rank", "score", "bm25_rank", "dense_rank"
        )
        top = single.union(both).join(queries.select("query_id", "top_k"), "query_id")
        return top.where(F.col("rank") <= F.col("top_k")).drop("top_k")

    return SearchResult(
        hits, lambda: match_signal(queries, partials, exact_matches(queries, corpus), signal)
    )


def search(
    queries: DataFrame, corpus: Corpus, mode: str = "hybrid", n_candidates: int = RRF_CANDIDATES,
    signal: str = "z",
) -> SearchResult:
    """One mode of search_all_modes: hybrid, bm25 or dense."""
    if mode not in ("hybrid", "bm25", "dense"):
        raise ValueError(f"mode must be hybrid, bm25 or dense, not {mode!r}")
    return search_all_modes(queries, corpus, n_candidates, signal).of_mode(mode)
