"""Benchmark decontamination with a broadcast hash set of the benchmark's word windows.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A window is `width`
consecutive words of a benchmark item; a shorter item is one window of all its words. Every window gets a
64-bit hash of its words' numbers. Documents are scanned in tasks: words outside the benchmark's
vocabulary end a run, runs are hashed at every position, hits are compared word by word with the
benchmark's windows, and the words inside them are marked.

The hash set is broadcast while the benchmark has at most `broadcast_words` words; beyond that the windows
are dealt out over several passes of the same scan, each with a part of that size, and a document's marks
are united. Results are the same.

Nulls: a null text has no words; an item without words has no window; a null item id is the text "null".
Empty tables: an empty benchmark hits nothing. Rows that repeat an id are each judged. Other columns
stay out.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.tables import text_of

WIDTH = 13
BROADCAST_WORDS = 2_000_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)

# Bytes that end a word become spaces, A-Z become a-z. Fixed values of the word rule.
WORD_BYTES = bytes(
    32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(WORD_BYTES).split()


@dataclass
class WindowSet:
    """The windows of one length: sorted hashes, and what each hash stands for."""

    length: int
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    windows: dict[int, list[tuple[tuple[int, ...], frozenset[str]]]] = field(default_factory=dict)


@dataclass
class BenchmarkIndex:
    """Word numbers (from 1) and one WindowSet per window length."""

    numbers: dict[bytes, int]
    sets: list[WindowSet]


def window_hashes(numbers: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every `length` consecutive numbers."""
    n = len(numbers) - length + 1
    values = (numbers.astype(np.uint64) + np.uint64(1)) * FACTOR
    values ^= values >> np.uint64(29)
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(length if n > 0 else 0):
        out = out * FACTOR + values[k : k + n]
    return out


def build_index(items: list[tuple[str, str | None]], width: int = WIDTH) -> BenchmarkIndex:
    numbers: dict[bytes, int] = {}
    found: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        ids = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text)]
        length = min(width, len(ids))
        for start in range(len(ids) - length + 1 if ids else 0):
            found[length][tuple(ids[start : start + length])].add(item)
    sets = []
    for length, windows in sorted(found.items()):
        one = WindowSet(length)
        keys = list(windows)
        hashes = np.array([window_hashes(np.array(k, np.int64), length)[0] for k in keys], np.uint64)
        for key, value in zip(keys, hashes.tolist(), strict=True):
            one.windows.setdefault(value, []).append((key, frozenset(windows[key])))
        one.hashes = np.unique(hashes)
        sets.append(one)
    return BenchmarkIndex(numbers, sets)


def scan(words: list[bytes], index: BenchmarkIndex) -> tuple[np.ndarray, set[str]]:
    """(a flag for each word that lies in a window, the items with occurring windows)."""
    number = index.numbers.get
    numbers = np.array([number(w, 0) for w in words], np.int64)
    hit, items = np.zeros(len(words), bool), set()
    known = np.concatenate([[0], np.cumsum(numbers > 0)])
    for one in index.sets:
        if len(words) < one.length:
            continue
        starts = np.flatnonzero(known[one.length :] - known[: -one.length] == one.length)
        if not len(starts):
            continue
        # Hashes are worked out for the known runs only: everything between the first and last start.
        low = starts[0]
        hashes = window_hashes(numbers[low : starts[-1] + one.length], one.length)[starts - low]
        place = np.minimum(np.searchsorted(one.hashes, hashes), len(one.hashes) - 1)
        for start, value in zip(
            starts[one.hashes[place] == hashes].tolist(), hashes[one.hashes[place] == hashes].tolist(), strict=True
        ):
            here = tuple(numbers[start : start + one.length].tolist())
            for key, holders in one.windows[value]:
                if key == here:
                    hit[start : start + one.length] = True
                    items |= holders
    return hit, items


def hit_ranges(hit: np.ndarray) -> list[int]:
    """Flags as [start, end, start, end, ...] of word positions."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return edges.tolist()


def _indexes(benchmark: DataFrame, item_column: str, text_column: str, width: int, limit: int) -> list[BenchmarkIndex]:
    """One index while the benchmark is small, else several of bounded size."""
    items = benchmark.select(
        F.coalesce(F.col(item_column).cast("string"), F.lit("null")).alias("item"), text_of(text_column).alias("text")
    )
    indexes, held, size = [], [], 0
    for row in items.toLocalIterator():
        held.append((row.item, row.text))
        size += len(words_of(row.text))
        if size >= limit:
            indexes.append(build_index(held, width))
            held, size = [], 0
    if held or not indexes:
        indexes.append(build_index(held, width))
    return indexes


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text", width: int = WIDTH,
    broadcast_words: int = BROADCAST_WORDS, keep: list[str] | None = None,
) -> DataFrame:
    """Per document: id, n_words, n_hit (words inside windows), hit_ranges (word positions, ends
    exclusive), n_items, items (their ids in string order, comma-joined), items_sha256, contaminated
    (n_hit > 0 and 20 * n_hit >= n_words), then the columns named in `keep`."""
    spark = docs.sparkSession
    parts = [
        spark.sparkContext.broadcast(x)
        for x in _indexes(benchmark, item_column, item_text_column, width, broadcast_words)
    ]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, ranges, items, n_items = [], [], [], []
            for text in batch.column("__text").to_pylist():
                words = words_of(text)
                hit, found = np.zeros(len(words), bool), set()
                for part in parts:
                    flags, holders = scan(words, part.value)
                    hit |= flags
                    found |= holders
                n_words.append(len(words))
                ranges.append(hit_ranges(hit))
                items.append(",".join(sorted(found)))
                n_items.append(len(found))
            columns = {
                "n_words": pa.array(n_words, pa.int64()),
                "n_hit": pa.array([sum(r[1::2]) - sum(r[::2]) for r in ranges], pa.int64()),
                "hit_ranges": pa.array(ranges, pa.list_(pa.int64())),
                "n_items": pa.array(n_items, pa.int64()),
                "items": pa.array(items, pa.string()),
                "items_sha256": pa.array([hashlib.sha256(i.encode()).hexdigest() for i in items], pa.string()),
            }
            kept = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), *columns.values()], [*kept, *columns]
            )

    kept = [F.col(c).alias(f"__keep_{n}") for n, c in enumerate(keep or [])]
    source = docs.select(F.col(id_column).alias("__id"), *kept, text_of(text_column).alias("__text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "__text")
    marked = source.mapInArrow(
        mark,
        f"{schema}, n_words long, n_hit long, hit_ranges array<bigint>, n_items long, items string, items_sha256 string",
    )
    return marked.select(
        F.col("__id").alias(id_column), "n_words", "n_hit", "hit_ranges", "n_items", "items", "items_sha256",
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        *(F.col(f"__keep_{n}").alias(c) for n, c in enumerate(keep or [])),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    marked = benchmark_hits(docs.select(F.struct("*").alias("row"), "doc_id", "text"), benchmark, keep=["row"], **options)
    return marked.where(~F.col("contaminated")).select("row.*")
