"""Okapi BM25 over documents kept as rows of counted tokens, with blocks of documents that a search can skip.

Documents are dealt into blocks of like length. A search finds the highest weight of its tokens in every
block, so the sum over a query's tokens bounds what any document of a block can score. A ranked search scores
each query's most promising blocks first; a block whose bound stays below the n-th score found there cannot
hold a document of the first n and is never read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.config import BM25_B, BM25_EPSILON, BM25_K1, RRF_CANDIDATES
from quarrylight.functions.text import tokenize, word_counts
from quarrylight.sources.staging import stage

# Scores are summed as whole numbers of 1e-9, so that the order of the sum cannot break a tie.
SCORE_UNIT = 1e9
#: Documents per block, on average, and ranges of document length that blocks are cut from.
BLOCK_DOCS = 2048
LENGTH_RANGES = 16
#: Blocks of a query that are scored before any block is skipped.
FIRST_BLOCKS = 2


@dataclass
class Bm25Index:
    """words(doc_id, kind, department, status, words ARRAY<STRUCT<token, tf>>, dl, n_rows, copies): a document is
    one row with its distinct tokens, so nothing but the text itself is shuffled to build it.

    n_rows: input rows behind the row; dl, copies: tokens and input rows of its doc_id. All else is read from
    these rows when asked for; only the counts of tokens are written.
    """

    words: DataFrame
    block_docs: int

    @property
    def docs(self) -> DataFrame:
        """docs(doc_id, dl), a row for every input row."""
        return self.words.select("doc_id", "dl", "n_rows").withColumn(
            "_row", F.explode(F.array_repeat(F.lit(1), F.col("n_rows").cast("int")))
        ).select("doc_id", "dl")

    @cached_property
    def block(self) -> Column:
        """The block of a document by its `dl` and `doc_id`."""
        return block_column(self.docs, self.block_docs)

    @cached_property
    def size(self) -> tuple[int, float | None]:
        """Documents and their mean length."""
        return tuple(self.docs.agg(F.count("*"), F.avg("dl")).first())

    @cached_property
    def terms(self) -> DataFrame:
        """terms(token, df, idf)."""
        counted = self.words.select(F.inline("words")).groupBy("token").agg(F.count("*").alias("df"))
        return term_statistics(stage(counted, "terms"), self.size[0])

    @property
    def postings(self) -> DataFrame:
        """postings(token, tf, block, doc_id, kind, department, status, dl, copies)."""
        return self.words.where("doc_id IS NOT NULL").select(
            F.inline("words"), "doc_id", "kind", "department", "status", "dl", "copies"
        ).withColumn("block", self.block)

    def postings_of(self, asked: DataFrame) -> DataFrame:
        """The postings of the asked(token) tokens with their `weight`.

        Tokens that nobody asks for are left out where they are read, before any shuffle.
        """
        tokens = asked.select("token").distinct().join(self.terms, "token").select("token", "idf")
        average = self.size[1]
        norm = F.lit(BM25_K1) * (F.lit(1 - BM25_B) + F.lit(BM25_B) * F.col("dl") / F.lit(average))
        return self.postings.join(stage(tokens, "asked-terms"), "token").withColumn(
            "weight", F.col("idf") * (F.col("tf") * (BM25_K1 + 1)) / (F.col("tf") + norm)
        )


def doc_lengths(docs: DataFrame) -> DataFrame:
    """Tokens per document, empty documents included."""
    return docs.select("doc_id", F.size(tokenize(F.col("bm25_text"))).alias("dl"))


def term_statistics(counted: DataFrame, n: int) -> DataFrame:
    """counted(token, df) of n documents -> token, df, idf: negative idf is replaced by a quarter of the mean
    idf over all tokens."""
    raw = counted.withColumn("raw", F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).first()[0]
    floor = F.lit(None if mean is None else mean * BM25_EPSILON).cast("double")
    return raw.select("token", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))


def block_column(lengths: DataFrame, block_docs: int = BLOCK_DOCS) -> Column:
    """The block of a document by its `dl` and `doc_id`: a range of lengths, cut into as many blocks as its share
    of lengths(doc_id, dl) asks for. Which documents share a block changes what is skipped, never a result."""
    n, cuts = lengths.agg(
        F.count("*"), F.percentile_approx("dl", [k / LENGTH_RANGES for k in range(1, LENGTH_RANGES)], 1000)
    ).first()
    ranges = max(1, min(LENGTH_RANGES, n // block_docs))
    each = max(1, -(-n // (ranges * block_docs)))
    bounds = sorted({cuts[k * LENGTH_RANGES // ranges - 1] for k in range(1, ranges)}) if cuts else []
    place = sum(((F.col("dl") > c).cast("long") for c in bounds), F.lit(0).cast("long"))
    return place * each + F.pmod(F.xxhash64("doc_id"), F.lit(each))


def block_of(lengths: DataFrame, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """lengths(doc_id, dl) with `block`."""
    return lengths.withColumn("block", block_column(lengths, block_docs))


def build_index(docs: DataFrame, block_docs: int = BLOCK_DOCS) -> Bm25Index:
    """Index docs(doc_id, kind, department, status, bm25_text), written once.

    The texts are dealt out by document, the only shuffle; rows of one document are counted together.
    """
    whose = ["doc_id", "kind", "department", "status"]
    of_id = Window.partitionBy("doc_id")
    merged = (
        docs.select(*whose, "bm25_text").repartition("doc_id").groupBy(*whose)
        .agg(F.collect_list("bm25_text").alias("texts"), F.count("*").alias("n_rows"))
        .withColumn("words", word_counts(F.flatten(F.transform("texts", tokenize))))
        .withColumn("own", F.aggregate("words", F.lit(0).cast("bigint"), lambda total, w: total + w["tf"]))
    )
    known = F.col("doc_id").isNotNull()
    words = merged.select(
        *whose, "words", F.when(known, F.sum("own").over(of_id)).otherwise(F.lit(0)).alias("dl"), "n_rows",
        F.sum("n_rows").over(of_id).alias("copies"),
    )
    return Bm25Index(stage(words, "words"), block_docs)


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, token, qtf and the query's filters; repeated words are counted."""
    return queries.select(
        "query_id", "kinds", "department", "include_deprecated",
        F.explode(tokenize(F.col("text"))).alias("token"),
    ).groupBy("query_id", "kinds", "department", "include_deprecated", "token").agg(
        F.count("*").alias("qtf")
    )


def allowed(query: str, doc: str):
    """Does a document pass a query's filters? No kinds or department means any."""
    return (
        (F.col(f"{query}.kinds").isNull()
         | F.array_contains(F.col(f"{query}.kinds"), F.col(f"{doc}.kind")))
        & (F.col(f"{query}.department").isNull()
           | F.col(f"{query}.department").eqNullSafe(F.col(f"{doc}.department")))
        & (F.col(f"{query}.include_deprecated")
           | ~F.col(f"{doc}.status").eqNullSafe(F.lit("deprecated")))
    )


def _score(terms: DataFrame, postings: DataFrame, on: list[str]) -> DataFrame:
    """(query_id, block, doc_id, score) from query terms that meet postings on their token (and block).

    A document of several rows counts once for each of them.
    """
    same = reduce(Column.__and__, [F.col(f"q.{c}") == F.col(f"p.{c}") for c in on])
    contribution = F.round(F.col("qtf") * F.col("weight") * SCORE_UNIT).cast("bigint") * F.col("copies")
    met = terms.alias("q").join(postings.alias("p"), same & allowed("q", "p"))
    return met.groupBy("query_id", F.col("p.block").alias("block"), "doc_id").agg(
        (F.sum(contribution) / F.lit(SCORE_UNIT)).alias("score")
    )


def bm25_scores(queries: DataFrame, index: Bm25Index) -> DataFrame:
    """(query_id, doc_id, score) for every document sharing a token and passing the filters.

    A small table of query terms goes to where the documents are read. Partial sums are taken before
    the shuffle on the pair.
    """
    terms = stage(query_terms(queries), "query-terms")
    return _score(terms, index.postings_of(terms), ["token"]).drop("block")


def top_weights(postings: DataFrame) -> DataFrame:
    """(token, block, top): the most that a token adds to a document of a block."""
    return postings.groupBy("token", "block").agg(F.max(F.col("weight") * F.col("copies")).alias("top"))


def block_bounds(terms: DataFrame, index: Bm25Index, postings: DataFrame | None = None) -> DataFrame:
    """(query_id, block, bound): no document of the block scores more for the query.

    A contribution is rounded to a whole SCORE_UNIT, so each token's bound is rounded up to one for every copy.
    """
    tops = stage(top_weights(index.postings_of(terms) if postings is None else postings), "tops")
    above = F.ceil(F.col("qtf") * F.greatest("top", F.lit(0.0)) * SCORE_UNIT) + F.col("most")
    most = index.words.agg(F.coalesce(F.max("copies"), F.lit(1))).first()[0]
    return terms.join(tops.withColumn("most", F.lit(most)), "token").groupBy("query_id", "block").agg(
        (F.sum(above) / F.lit(SCORE_UNIT)).alias("bound")
    )


def _best_of_blocks(scores: DataFrame, n: int) -> DataFrame:
    """At most n rows of every (query, block): the only ones that can rank among the query's first n."""
    order = Window.partitionBy("query_id", "block").orderBy(F.desc("score"), "doc_id")
    return scores.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n).drop("_place")


def rank_bm25(
    queries: DataFrame, index: Bm25Index, n: int = RRF_CANDIDATES, first_blocks: int = FIRST_BLOCKS
) -> DataFrame:
    """The best n documents per query by (score desc, doc_id): (query_id, doc_id, score, rank).

    Two rounds. Each query's `first_blocks` blocks with the highest bounds are scored; its n-th score there
    is a floor under the final n-th score. Of the other blocks only those whose bound reaches the floor are
    scored. A (query, block) hands on n rows at most. The result is that of ranking all scores.
    """
    first, rest = ranked_rounds(queries, index, n, first_blocks)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return (
        first.unionByName(rest).drop("block")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
    )


def ranked_rounds(queries: DataFrame, index: Bm25Index, n: int, first_blocks: int) -> tuple[DataFrame, DataFrame]:
    """What the two rounds of rank_bm25 find: (query_id, block, doc_id, score), n rows a block at most."""
    terms = stage(query_terms(queries), "query-terms")
    postings = index.postings_of(terms)
    bounds = block_bounds(terms, index, postings)
    by_bound = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    placed = stage(bounds.withColumn("place", F.row_number().over(by_bound)), "block-bounds")

    def found(blocks: DataFrame) -> DataFrame:
        # Written, so that Spark knows whether the terms are few enough to go to every task.
        dealt = stage(terms.join(blocks, "query_id"), "dealt-terms")
        return _best_of_blocks(_score(dealt, postings, ["token", "block"]), n)

    first = stage(found(placed.where(F.col("place") <= first_blocks).select("query_id", "block")), "first-blocks")
    in_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    floors = first.withColumn("_place", F.row_number().over(in_query)).where(F.col("_place") == n).select(
        "query_id", F.col("score").alias("floor")
    )
    left = placed.where(F.col("place") > first_blocks).join(floors, "query_id", "left")
    reaching = left.where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor"))).select("query_id", "block")
    return first, found(reaching)
