"""Exact cosine search by blocked matrix products, with the background moments of every query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.config import NO_SPREAD, RRF_CANDIDATES

# At most this many query vectors are handed to every task; more are met block by block.
BROADCAST_QUERIES = 4096
# Documents per block when the queries are too many to hand out.
BLOCK_DOCS = 65_536
# Cosines that a task holds at a time: 32 MB of doubles.
CELL_COSINES = 4_194_304
# Cosines are ranked at nine digits, so equal vectors tie whatever block they are in.
DIGITS = 9

_PARTIAL = (
    "query_id string, doc_id string, cosine double, n bigint, total double, squares double"
)


def _allowed(docs: pd.DataFrame, query: tuple) -> np.ndarray:
    """Which documents pass a filter (kinds, department, include_deprecated)?"""
    kinds, department, include_deprecated = query
    mask = np.ones(len(docs), dtype=bool)
    if kinds is not None:
        mask &= docs["kind"].isin(kinds).to_numpy()
    if department is not None:
        mask &= (docs["department"] == department).to_numpy()
    if not include_deprecated:
        mask &= (docs["status"] != "deprecated").to_numpy()
    return mask


def _filters(queries: pd.DataFrame) -> list[tuple]:
    return [
        (None if k is None else tuple(k), d, bool(i))
        for k, d, i in zip(
            queries["kinds"], queries["department"], queries["include_deprecated"], strict=True
        )
    ]


def _best(ids: np.ndarray, cosines: np.ndarray, n: int) -> np.ndarray:
    """Positions of the best n by (cosine desc, id)."""
    if len(ids) > n:
        cut = np.partition(cosines, len(cosines) - n)[len(cosines) - n]
        near = np.flatnonzero(cosines >= cut)
    else:
        near = np.arange(len(ids))
    return near[np.lexsort((ids[near], -cosines[near]))][:n]


def _block(
    docs: pd.DataFrame, queries: pd.DataFrame, n: int, skip_self: bool
) -> Iterator[pd.DataFrame]:
    """Per query: its best n of these documents, and one row of moments over all of them.

    Queries are taken a slice at a time, so no more than CELL_COSINES cosines exist at once.
    """
    if not len(docs) or not len(queries):
        return
    left = np.stack(docs["embedding"].to_numpy()).astype(np.float64)
    ids = docs["doc_id"].to_numpy().astype(str)
    own = pd.Series(ids).groupby(ids).indices if skip_self else {}
    filters = _filters(queries)
    # Queries with the same filter share its mask.
    masks = {one: _allowed(docs, one) for one in set(filters)}
    step = max(1, CELL_COSINES // len(docs))
    for start in range(0, len(queries), step):
        some = queries.iloc[start : start + step]
        right = np.stack(some["embedding"].to_numpy()).astype(np.float64)
        cosines = right @ left.T
        np.round(cosines, DIGITS, out=cosines)
        cosines += 0.0  # no negative zeros
        found: dict[str, list] = {"query_id": [], "doc_id": [], "cosine": []}
        moments: dict[str, list] = {"query_id": [], "n": [], "total": [], "squares": []}
        for j, query_id in enumerate(some["query_id"]):
            keep = masks[filters[start + j]]
            if query_id in own:
                keep = keep.copy()
                keep[own[query_id]] = False
            mine, my_ids = cosines[j, keep], ids[keep]
            if not len(mine):
                continue
            best = _best(my_ids, mine, n)
            found["query_id"].append(np.full(len(best), query_id, dtype=object))
            found["doc_id"].append(my_ids[best].astype(object))
            found["cosine"].append(mine[best])
            moments["query_id"].append(query_id)
            moments["n"].append(len(mine))
            moments["total"].append(mine.sum())
            moments["squares"].append(np.square(mine).sum())
        if not moments["query_id"]:
            continue
        hits = pd.DataFrame({name: np.concatenate(parts) for name, parts in found.items()})
        yield hits.assign(n=pd.array([pd.NA] * len(hits), dtype="Int64"), total=np.nan, squares=np.nan)
        sums = pd.DataFrame(moments).assign(doc_id=None, cosine=np.nan).astype({"n": "Int64"})
        yield sums[["query_id", "doc_id", "cosine", "n", "total", "squares"]]


def dense_partials(
    queries: DataFrame, docs: DataFrame, n: int = RRF_CANDIDATES, skip_self: bool = False
) -> DataFrame:
    """Best-n lists and moments per query and block of documents.

    queries(query_id, embedding, kinds, department, include_deprecated);
    docs(doc_id, embedding, kind, department, status). A small, counted set of queries is handed
    to every task and the documents stream past it without a shuffle. Beyond that size both
    sides are cut into blocks and every pair of blocks is one task-sized matrix product.
    """
    queries = queries.select("query_id", "embedding", "kinds", "department", "include_deprecated")
    docs = docs.select("doc_id", "embedding", "kind", "department", "status")
    if queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES:
        shared = queries.sparkSession.sparkContext.broadcast(queries.toPandas())

        def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield from _block(batch, shared.value, n, skip_self)

        return docs.mapInPandas(stream, _PARTIAL)
    query_blocks = int(np.ceil(queries.count() / BROADCAST_QUERIES))
    doc_blocks = int(np.ceil(docs.count() / BLOCK_DOCS))
    left = queries.withColumn(
        "qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks))
    ).withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(doc_blocks - 1))))
    right = docs.withColumn("db", F.pmod(F.xxhash64("doc_id"), F.lit(doc_blocks))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    )
    left = left.withColumn("db", F.col("db").cast("bigint"))
    # Queries and documents may come from one table: names of their own keep the two sides' columns apart.
    right = right.withColumn("qb", F.col("qb").cast("bigint")).select(
        *[F.col(c).alias(f"right_{c}") for c in [*docs.columns, "qb", "db"]]
    )

    def cell(some_queries: pd.DataFrame, some_docs: pd.DataFrame) -> pd.DataFrame:
        some_docs = some_docs.rename(columns=lambda name: name.removeprefix("right_"))
        parts = list(_block(some_docs, some_queries, n, skip_self))
        if parts:
            return pd.concat(parts, ignore_index=True)
        return pd.DataFrame(
            {"query_id": pd.Series(dtype=str), "doc_id": pd.Series(dtype=str),
             "cosine": pd.Series(dtype=float), "n": pd.Series(dtype="Int64"),
             "total": pd.Series(dtype=float), "squares": pd.Series(dtype=float)}
        )

    return (
        left.groupBy("qb", "db").cogroup(right.groupBy("right_qb", "right_db")).applyInPandas(cell, _PARTIAL)
    )


def rank_dense(partials: DataFrame, n: int = RRF_CANDIDATES) -> DataFrame:
    """The best n documents per query by (cosine desc, doc_id) out of the block lists."""
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "doc_id")
    return (
        partials.where("doc_id IS NOT NULL").select("query_id", "doc_id", "cosine")
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
    )


def dense_background(partials: DataFrame) -> DataFrame:
    """Per query: top cosine, and how many (population) deviations it is above the mean."""
    sums = partials.groupBy("query_id").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"),
        F.max("cosine").alias("top_cosine"),
    )
    mean = F.col("total") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)))
    z = F.when(spread > NO_SPREAD, (F.col("top_cosine") - mean) / spread).otherwise(F.lit(0.0))
    return sums.select("query_id", "top_cosine", z.alias("dense_z"), "n")
