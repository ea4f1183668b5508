"""Ranked lexical search: Block-Max MaxScore over a sharded, compressed index.

Index. A first pass counts documents and terms. Every task then cuts its documents into shards of at most
`SHARD_WORDS` terms (a longer document is a shard of its own) and inverts each: a row per shard and term with
postings in ascending document order, as variable-byte gaps and frequencies, in blocks of `BLOCK` postings.
A row keeps, for every block, its last document, its place in the bytes and its highest score part, so a block
can be judged without being decompressed.

Search. Lists of query terms meet their weights and go to their shard, where every query runs alone. Lists are
ordered by their bound (weight times the list's highest part). Windows of documents pass one after another.
The lists whose bounds together stay below the lowest score in the heap cannot alone lift a document into it:
they are non-essential. Essential lists are decompressed for the window and summed; a document then stays only
while its sum, its block maxima in the non-essential lists looked at so far, and the bounds of the rest still
reach the heap. A non-essential block is decompressed only if such a document lies in it. Shard heaps, `k`
rows a query, are merged by a window that keeps `k` rows a query in every task first.

Scores are integers, so they are equal whatever the order of sums. Equal scores rank by ascending document id.

Nulls: a null text has no terms and no rank; a null document id ranks behind others of its score; a null item id
is an item. Equal benchmark rows (id and text) are one query, rows that share an id only are queries each.
Repeated documents are ranked each. Empty tables give no rows. Other columns stay out.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.decontamination import words_of
from quarrylight.llm.tables import text_of
from quarrylight.sources.staging import stage

BLOCK = 128
SHARD_WORDS = 1 << 22
WINDOW = 8192
#: Terms of queries that are broadcast at once; further queries take another round over the index.
QUERY_TERMS = 1_000_000
POSTINGS_SCHEMA = (
    "shard string, term binary, df long, top long, lasts binary, places binary, tops binary, postings binary"
)
SHARD_SCHEMA = "ids binary, nulls binary, sizes binary"
#: The highest score part a posting can have. Fixed value of the score.
SCALE = 1_000_000_000


def encode_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-byte code of non-negative integers below 2^35: (bytes, place of every number)."""
    sizes = 1 + sum((values >> (7 * k) > 0).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        more = sizes > k
        out[starts[more] + k] = (values[more] >> (7 * k) & 127) | np.where(sizes[more] > k + 1, 128, 0)
    return out, starts


def decode_numbers(raw: np.ndarray) -> np.ndarray:
    """The numbers of `encode_numbers`."""
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    shifts = 7 * (np.arange(len(raw)) - np.repeat(starts, ends - starts + 1))
    return np.add.reduceat((raw & 127).astype(np.int64) << shifts, starts)


def corpus_size(texts: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms with repeats)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(words_of(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, sizes))]), pa.array([sum(sizes)])], ["n", "length"])

    row = texts.select("text").mapInArrow(count, "n long, length long").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
    return row.n or 0, row.length or 0


class Numbers(dict):
    """Terms numbered in the order they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = found = len(self)
        return found


def score_parts(tf: np.ndarray, sizes: np.ndarray, n: int, length: int) -> np.ndarray:
    """The part of a score that a term's weight multiplies."""
    return SCALE * tf // (1000 * tf + 8 * (25 + 75 * sizes * n // length))


def invert(name: str, terms: list[np.ndarray], numbers: Numbers, sizes: np.ndarray, n: int, length: int) -> pa.RecordBatch:
    """The postings rows of one shard; `terms` holds the numbers of each document's words."""
    docs = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    pairs, tf = np.unique(np.concatenate(terms).astype(np.int64) * len(terms) + docs, return_counts=True)
    term, doc = np.divmod(pairs, len(terms))
    parts = score_parts(tf.astype(np.int64), sizes[doc], n, length)
    lists = np.flatnonzero(np.diff(term, prepend=-1))
    df = np.diff(np.append(lists, len(term)))
    within = np.arange(len(term)) - np.repeat(lists, df)
    gaps = np.where(within == 0, doc, doc - np.concatenate([[0], doc[:-1]]))
    heads = np.flatnonzero(within % BLOCK == 0)
    # Blocks start from the document number itself, so each is decoded alone.
    gaps[heads] = doc[heads]
    raw, places = encode_numbers(np.stack([gaps, tf], axis=1).ravel())
    places = places[::2]
    block_ends = np.append(heads[1:], len(term)) - 1
    list_bytes = np.append(places[lists], len(raw))
    blocks = np.searchsorted(heads, np.append(lists, len(term)))

    def cut(values: np.ndarray, edges: np.ndarray, kind: str) -> pa.Array:
        """One binary value per list: the values between its edges."""
        data = np.ascontiguousarray(values, dtype=kind)
        offsets = (edges * data.itemsize).astype("<i8")
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return whole.cast(pa.binary())

    tops = np.maximum.reduceat(parts, heads)
    block_places = places[heads] - np.repeat(places[lists], np.diff(blocks))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([name] * len(lists)), pa.array(list(numbers), pa.binary()), pa.array(df.astype(np.int64)),
            pa.array(np.maximum.reduceat(parts, lists)), cut(doc[block_ends], blocks, "<u4"), cut(block_places, blocks, "<u4"),
            cut(tops, blocks, "<u4"), cut(raw, list_bytes, "u1"),
        ],
        [f.split()[0] for f in POSTINGS_SCHEMA.split(", ")],
    )


@dataclass
class Index:
    """The table of an index: a row per shard and term, and a row without term per shard with its documents'
    ids and sizes. n documents of `length` terms in all."""

    table: DataFrame
    n: int
    length: int


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shard_words: int = SHARD_WORDS) -> Index:
    """Invert every document. The table is written once, by the tasks that read the texts: no shuffle."""
    texts = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    n, length = corpus_size(texts)
    fields = [f.split()[0] for f in POSTINGS_SCHEMA.split(", ")]
    of_shard = [f.split()[0] for f in SHARD_SCHEMA.split(", ")]

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        numbers, terms, ids, held = Numbers(), [], [], 0

        def shard() -> Iterator[pa.RecordBatch]:
            # Documents go by ascending id, so that of equal scores the first in a shard ranks first.
            order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
            sizes = np.array([len(terms[k]) for k in order], np.int64)
            name = f"{part}-{number}"
            inverted = invert(name, [terms[k] for k in order], numbers, sizes, n, length)
            sorted_ids = np.array([ids[k] or 0 for k in order], "<i8")
            nulls = np.array([ids[k] is None for k in order], np.uint8)
            head = [name, None, None, None, None, None, None, None, sorted_ids.tobytes(), nulls.tobytes(), sizes.astype("<i8").tobytes()]
            types = [pa.string(), pa.binary(), pa.int64(), pa.int64(), *[pa.binary()] * 7]
            names = [*fields, *of_shard]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(head, types, strict=True)], names)
            for start in range(0, inverted.num_rows, 10_000):
                rows = inverted.slice(start, 10_000)
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.nulls(rows.num_rows, pa.binary()) for _ in of_shard)], names)

        for batch in batches:
            for name, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                if not words:
                    continue
                if held and held + len(words) > shard_words:
                    yield from shard()
                    numbers, terms, ids, held, number = Numbers(), [], [], 0, number + 1
                terms.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                ids.append(name)
                held += len(words)
        if held:
            yield from shard()

    table = stage(texts.mapInArrow(shards, f"{POSTINGS_SCHEMA}, {SHARD_SCHEMA}"), "search-index")
    return Index(table, n, length)


class PostingList:
    """One list of a shard; blocks are decompressed when asked for."""

    def __init__(self, weight: int, top: int, lasts: bytes, places: bytes, tops: bytes, postings: bytes):
        self.weight, self.bound = weight, weight * top
        self.lasts = np.frombuffer(lasts, "<u4").astype(np.int64)
        self.places = np.append(np.frombuffer(places, "<u4").astype(np.int64), len(postings))
        self.tops = np.frombuffer(tops, "<u4").astype(np.int64) * weight
        self.raw = np.frombuffer(postings, np.uint8)

    def read(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, frequencies) of the blocks of these numbers, ascending."""
        first, last = int(blocks[0]), int(blocks[-1])
        if last - first + 1 == len(blocks):
            raw, heads = self.raw[self.places[first] : self.places[last + 1]], self.places[first : last + 1] - self.places[first]
        else:
            raw = np.concatenate([self.raw[self.places[b] : self.places[b + 1]] for b in blocks.tolist()])
            sizes = self.places[blocks + 1] - self.places[blocks]
            heads = np.cumsum(sizes) - sizes
        numbers = decode_numbers(raw)
        gaps, tf = numbers[::2], numbers[1::2]
        # Every block holds BLOCK postings but the list's last, which comes last here too.
        starts = np.arange(len(heads)) * BLOCK
        sums = np.cumsum(gaps)
        before = sums[starts] - gaps[starts]
        return sums - np.repeat(before, np.diff(np.append(starts, len(gaps)))), tf


class Heap:
    """The k best of a shard: highest score, then first document."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def low(self) -> int:
        """A score below this cannot enter; at least 1."""
        return self.rows[0][0] + 1 if len(self.rows) == self.k else 1

    def offer(self, docs: np.ndarray, scores: np.ndarray) -> None:
        for doc, score in zip(docs.tolist(), scores.tolist(), strict=True):
            if len(self.rows) < self.k:
                heapq.heappush(self.rows, (score, -doc))
            elif score >= self.low():
                heapq.heappushpop(self.rows, (score, -doc))


@dataclass
class Work:
    """How many blocks a search had and how many it decompressed."""

    blocks: int = 0
    read: int = 0


def search_shard(lists: list[PostingList], sizes: np.ndarray, k: int, n: int, length: int, work: Work | None = None) -> Heap:
    """The k best documents (numbers) of a shard for one query. Documents pass in ascending number, so a later
    one of an equal score never replaces an earlier one: only scores above the lowest kept enter."""
    heap, work = Heap(k), work or Work()
    lists = sorted(lists, key=lambda x: x.bound)
    below = np.cumsum([0, *(x.bound for x in lists)])
    work.blocks += sum(len(x.lasts) for x in lists)
    for low in range(0, len(sizes), WINDOW):
        high = min(low + WINDOW, len(sizes))
        # Lists before `essential` cannot reach the heap even together.
        essential = int(np.searchsorted(below[1:], heap.low(), "left"))
        sums = np.zeros(high - low, np.int64)
        for one in lists[essential:]:
            first, last = np.searchsorted(one.lasts, [low, high - 1])
            blocks = np.arange(first, min(int(last) + 1, len(one.lasts)))
            if len(blocks):
                work.read += len(blocks)
                docs, tf = one.read(blocks)
                inside = (docs >= low) & (docs < high)
                docs, tf = docs[inside], tf[inside]
                sums[docs - low] += one.weight * score_parts(tf, sizes[docs], n, length)
        docs = np.flatnonzero(sums) + low
        scores = sums[docs - low]
        docs, scores = _reaching(docs, scores, scores + below[essential], heap.low())
        for place in range(essential - 1, -1, -1):
            if not len(docs):
                break
            one = lists[place]
            block = np.searchsorted(one.lasts, docs)
            covered = block < len(one.lasts)
            limit = np.where(covered, one.tops[np.minimum(block, len(one.tops) - 1)], 0)
            reaching = scores + limit + below[place] >= heap.low()
            docs, scores, block, covered = docs[reaching], scores[reaching], block[reaching], covered[reaching]
            wanted = np.unique(block[covered])
            if len(wanted):
                work.read += len(wanted)
                held, tf = one.read(wanted)
                at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
                met = held[at] == docs
                scores = scores + np.where(met, one.weight * score_parts(tf[at], sizes[docs], n, length), 0)
            docs, scores = _reaching(docs, scores, scores + below[place], heap.low())
        # Of many candidates only the k best (of equal scores the first) are offered one by one.
        if len(docs) > k:
            best = np.sort(np.lexsort((docs, -scores))[:k])
            docs, scores = docs[best], scores[best]
        heap.offer(docs, scores)
    return heap


def _reaching(docs: np.ndarray, scores: np.ndarray, bounds: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    kept = bounds >= low
    return docs[kept], scores[kept]


def query_terms(queries: DataFrame, item_column: str, text_column: str) -> DataFrame:
    """(query, item, term, times) for every term of every query; `query` tells queries apart."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("query"), pa.array(words, pa.list_(pa.binary()))], ["query", "terms"])

    rows = queries.select(F.col(item_column).alias("item"), text_of(text_column).alias("text"))
    named = rows.select(F.to_json(F.struct("item", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))).alias("query"), "text").distinct()
    split_terms = named.mapInArrow(split, "query string, terms array<binary>").select("query", F.explode("terms").alias("term"))
    return split_terms.groupBy("query", "term").agg(F.count("*").alias("times"))


def term_weight(n: Column | int, df: Column) -> Column:
    ratio = F.lit(2 * n + 2).cast("double") / (2 * df + 1).cast("double")
    return F.floor(1000 * F.log(ratio)).cast("long")


def search(
    index: Index, queries: DataFrame, k: int = 10, id_column: str = "doc_id", item_column: str = "item_id",
    text_column: str = "text", query_limit: int = QUERY_TERMS,
) -> DataFrame:
    """The k best documents of every query: item id, rank (from 1), document id, score above 0.

    The queries are broadcast while they have at most `query_limit` distinct terms in all; beyond that they are
    dealt into rounds of that size, each of which reads the lists of its own terms only.
    """
    spark = queries.sparkSession
    terms = stage(query_terms(queries, item_column, text_column), "query-terms")
    rounds = max(1, -(-terms.count() // query_limit))
    found = []
    for number in range(rounds):
        asked = terms.where(F.pmod(F.xxhash64("query"), F.lit(rounds)) == number) if rounds > 1 else terms
        found.append(_round(index, asked, k))
    heaps = found[0]
    for one in found[1:]:
        heaps = heaps.unionByName(one)
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = heaps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    kind = queries.schema[item_column].dataType.simpleString()
    item = F.from_json("query", f"item {kind}")["item"].alias(item_column)
    return ranked.select(item, "rank", F.col("id").alias(id_column), "score")


def _round(index: Index, terms: DataFrame, k: int) -> DataFrame:
    """The shard heaps of one round of queries."""
    spark, n, length = terms.sparkSession, index.n, index.length
    asked = F.broadcast(terms.select("term").distinct())
    lists = stage(index.table.join(asked, "term", "left_semi").select(*index.table.columns), "query-lists")
    weights = lists.groupBy("term").agg(F.sum("df").alias("n")).select("term", term_weight(n, F.col("n")).alias("weight"))
    # One row per distinct (query, term) whose term occurs: bounded by the round.
    weighted = terms.join(weights, "term").where("weight > 0").select("query", "term", (F.col("times") * F.col("weight")).alias("weight"))
    by_query = defaultdict(list)
    for row in weighted.collect():
        by_query[row.query].append((bytes(row.term), row.weight))
    shared = spark.sparkContext.broadcast(dict(by_query))
    lists_and_documents = lists.unionByName(index.table.where("term is null"))

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        whole = shard[shard["term"].isna()].iloc[0]
        ids, nulls, sizes = (np.frombuffer(whole[c], t) for c, t in (("ids", "<i8"), ("nulls", np.uint8), ("sizes", "<i8")))
        kept = shard[shard["term"].notna()]
        known = {bytes(x.term): (x.top, x.lasts, x.places, x.tops, x.postings) for x in kept.itertuples()}
        out = []
        for query, asked_terms in shared.value.items():
            here = [PostingList(w, *known[t]) for t, w in asked_terms if t in known]
            for score, doc in search_shard(here, sizes, k, n, length).rows if here else []:
                out.append((query, None if nulls[-doc] else int(ids[-doc]), score))
        frame = pd.DataFrame(out, columns=["query", "id", "score"])
        return frame.astype({"query": object, "id": "Int64", "score": "int64"})

    return lists_and_documents.groupBy("shard").applyInPandas(run, "query string, id long, score long")

