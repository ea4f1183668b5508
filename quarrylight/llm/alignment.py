"""Cross-tokenizer alignment with white-space tokens as anchors.

A text is tokenised whole by a byte-level tokenizer (A) and a sentence-piece model (B), and both give the
bytes of the text with a space in front. Where both sides start a space-marked token at the same byte, the
tokens before it share that end (verified by the summed lengths of the tokens' bytes), so the document splits
there into windows of token ids. A window is aligned once and remembered by its ids: its groups (cut where
both sides end a token) and its links (pairs of tokens whose byte ranges overlap).

How many documents link an id pair is counted over the corpus: every task counts the pairs of its own
documents first. The counts go back to the documents in a broadcast while there are at most `broadcast_pairs`
of them (a pair is one of vocabulary A times vocabulary B), and by a join with split hot pairs beyond that.

Nulls: a null or empty text, and one whose tokens do not give back its bytes, has no tokens: zeros and an
empty groups_sha256. A null id stays null. Empty tables give empty results; rows that repeat an id or a text
are documents each, and count each. Texts of any length are aligned whole; windows of over REMEMBERED_TOKENS
tokens are aligned in the same way and not remembered. Other columns stay out.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.byte_level import byte_level_ids, token_bytes
from quarrylight.llm.tables import text_of
from quarrylight.llm.tokenizing import Remembered
from quarrylight.operators.skew import fan_out_hot_keys, split_hot_keys
from quarrylight.sources.staging import stage

#: Id pairs whose counts are broadcast, at 17 bytes each.
BROADCAST_PAIRS = 4_000_000
REMEMBERED_TOKENS = 64
COUNTED_AT_ONCE = 2_000_000
ALIGNED_SCHEMA = (
    "part int, position long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
)


@dataclass
class Vocabulary:
    """Per token id: its bytes' length, and whether they start with a space."""

    content: list[bytes]
    lengths: np.ndarray = field(init=False)
    spaced: np.ndarray = field(init=False)

    def __post_init__(self):
        self.lengths = np.array([len(b) for b in self.content], np.int64)
        self.spaced = np.array([b[:1] == b" " for b in self.content], bool)


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of every piece by id: U+2581 is a space, <0xHH> is one byte, control pieces are empty."""
    found = []
    for number in range(model.get_piece_size()):
        piece = model.id_to_piece(number)
        if model.is_byte(number):
            found.append(bytes([int(piece[3:-1], 16)]))
        else:
            found.append(b"" if model.is_control(number) or model.is_unknown(number) else piece.replace("▁", " ").encode())
    return found


class Windows(Remembered):
    """Alignments by id tuples: (groups as text, codes of the linked id pairs as int64 bytes).

    A key is a window's A ids, a mark no id has, and its B ids, packed by `ids` into one run of bytes, which is
    small to keep and quick to compare. A pair's code is a * (B's vocabulary) + b.
    """

    generation = 500_000

    def __init__(self, a: Vocabulary, b: Vocabulary):
        super().__init__()
        self.a_lengths, self.b_lengths, self.b_size = a.lengths.tolist(), b.lengths.tolist(), len(b.content)
        self.ids = np.dtype("=u2" if max(len(a.content), len(b.content)) < (1 << 16) - 1 else "=u4")
        self.mark = (1 << 8 * self.ids.itemsize) - 1
        self.between = np.array([self.mark], self.ids).tobytes()
        self.kept_bytes = REMEMBERED_TOKENS * self.ids.itemsize
        self.a_names, self.b_names = (list(map(str, range(len(v.content)))) for v in (a, b))

    def work_out(self, key: bytes) -> tuple[str, bytes]:
        """One step for each distinct end: two ranges overlap in one range without an end inside, so every
        end closes one link."""
        a_lengths, b_lengths, b_size = self.a_lengths, self.b_lengths, self.b_size
        both = memoryview(key).cast(self.ids.char).tolist()
        split = both.index(self.mark)
        a, b = both[:split], both[split + 1 :]
        a_names, b_names = [self.a_names[x] for x in a], [self.b_names[x] for x in b]
        if len(a) == 1 or len(b) == 1:
            # One token spans the window: one group, linked with every token of the other side.
            codes = [x * b_size + y for x in a for y in b]
            return f"{','.join(a_names)}|{','.join(b_names)}", pack(f"{len(codes)}q", *codes)
        codes, groups = [], []
        i = j = a_from = b_from = 0
        ahead = a_lengths[a[0]] - b_lengths[b[0]]
        while True:
            codes.append(a[i] * b_size + b[j])
            if ahead < 0:
                i += 1
                ahead += a_lengths[a[i]]
            elif ahead > 0:
                j += 1
                ahead -= b_lengths[b[j]]
            else:
                i, j = i + 1, j + 1
                groups.append(f"{','.join(a_names[a_from:i])}|{','.join(b_names[b_from:j])}")
                if i == len(a):
                    return ";".join(groups), pack(f"{len(codes)}q", *codes)
                a_from, b_from = i, j
                ahead = a_lengths[a[i]] - b_lengths[b[j]]

    def __missing__(self, key: bytes):
        return super().__missing__(key) if len(key) <= self.kept_bytes else self.work_out(key)


@dataclass
class Aligned:
    """One document: token numbers, groups as text, and the code of every link (repeats included)."""

    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    groups: str = ""
    codes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        found = byte_level_ids(a_path, plain=True)
        self.encode_a = found.ids
        # A byte-level file that is told by ranks has no normaliser and a token for every byte: it loses nothing.
        self.a_whole = found.by_rank is not None
        self.model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a, self.b = Vocabulary(token_bytes(a_path)), Vocabulary(piece_bytes(self.model))
        self.a_bytes, self.b_bytes = self.a.content.__getitem__, self.b.content.__getitem__
        self.windows = Windows(self.a, self.b)

    def align(self, text: str) -> Aligned:
        if not text:
            return Aligned()
        raw = b" " + text.encode()
        a, b = self.encode_a(" " + text), self.model.encode(text)
        if b"".join(map(self.b_bytes, b)) != raw or (not self.a_whole and b"".join(map(self.a_bytes, a)) != raw):
            return Aligned()
        windows, size = self.windows, self.windows.ids.itemsize
        a_ids, b_ids = (np.frombuffer(array(windows.ids.char, x), windows.ids) for x in (a, b))
        a_lengths, b_lengths = self.a.lengths[a_ids], self.b.lengths[b_ids]
        a_starts, b_starts = np.cumsum(a_lengths) - a_lengths, np.cumsum(b_lengths) - b_lengths
        marked = np.intersect1d(a_starts[self.a.spaced[a_ids]], b_starts[self.b.spaced[b_ids]], assume_unique=True)
        a_packed, b_packed, between = a_ids.tobytes(), b_ids.tobytes(), windows.between
        i = [*(np.searchsorted(a_starts, marked) * size).tolist(), len(a_packed)]
        j = [*(np.searchsorted(b_starts, marked) * size).tolist(), len(b_packed)]
        found = [windows[a_packed[p:q] + between + b_packed[r:s]] for p, q, r, s in zip(i, i[1:], j, j[1:], strict=False)]
        groups, packed = zip(*found, strict=True)
        codes = np.frombuffer(b"".join(packed), np.int64)
        # Links stand for the ends of either side, groups for the ends of both.
        return Aligned(len(a), len(b), len(a) + len(b) - len(codes), ";".join(groups), codes)


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def pack_links(codes: np.ndarray) -> bytes:
    """The distinct codes in ascending order and how often each occurs, compressed."""
    distinct, times = np.unique(codes, return_counts=True)
    steps = np.diff(distinct, prepend=0)
    wide = np.dtype("<u4") if len(distinct) == 0 or max(int(steps.max()), int(times.max())) < 1 << 32 else np.dtype("<u8")
    planes = np.concatenate([steps, times]).astype(wide).view(np.uint8).reshape(-1, wide.itemsize).T
    return bytes([wide.itemsize]) + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack_links(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(codes, times) of `pack_links`."""
    width = packed[0]
    planes = np.frombuffer(zstandard.decompress(packed[1:]), np.uint8).reshape(width, -1)
    values = np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)
    half = len(values) // 2
    return np.cumsum(values[:half]), values[half:]


def align_documents(
    docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text", with_groups: bool = False
) -> DataFrame:
    """Per document: part and position (which tell rows apart), id, n_a, n_b, n_groups, n_links,
    groups_sha256, links (see `pack_links`) and, if asked, groups as text `a1,a2|b1;a3|b2,b3`."""
    schema = ALIGNED_SCHEMA + (", groups string" if with_groups else "")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, part, position = aligner(a_path, b_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = batch.slice(start, 500)
                out: list[list] = [[] for _ in range(7 if with_groups else 6)]
                for text in rows.column("text").to_pylist():
                    found = pair.align(text)
                    digest = hashlib.sha256(found.groups.encode()).hexdigest() if found.n_a else ""
                    row = [found.n_a, found.n_b, found.n_groups, len(found.codes), digest, pack_links(found.codes), found.groups]
                    for column, value in zip(out, row, strict=False):
                        column.append(value)
                n = rows.num_rows
                types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.string()]
                columns = [pa.array(v, t) for v, t in zip(out, types, strict=False)]
                names = [f.split()[0] for f in schema.split(", ")]
                places = [pa.array([part] * n, pa.int32()), pa.array(range(position, position + n), pa.int64())]
                yield pa.RecordBatch.from_arrays([*places, rows.column("id"), *columns], names)
                position += n

    source = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    return source.mapInArrow(align, schema)


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(code, n, best): the documents that link each id pair; best where n is its A id's highest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])

        held, size = [], 0
        codes, totals = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            several = np.concatenate([codes, *held])
            weights = np.concatenate([totals, np.ones(size, np.int64)])
            distinct, place = np.unique(several, return_inverse=True)
            return distinct, np.bincount(place, weights, len(distinct)).astype(np.int64)

        for batch in batches:
            for packed in batch.column("links").to_pylist():
                held.append(unpack_links(packed)[0])
                size += len(held[-1])
                if size >= COUNTED_AT_ONCE:
                    codes, totals = merged()
                    held, size = [], 0
                    if len(codes) >= COUNTED_AT_ONCE:
                        yield told(codes, totals)
                        codes, totals = codes[:0], totals[:0]
        yield told(*merged())

    counted = aligned.select("links").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counted = stage(counted.withColumn("a", F.floor(F.col("code") / b_size).cast("long")), "pair-counts")
    highest = counted.groupBy("a").agg(F.max("n").alias("highest"))
    return counted.join(highest, "a").select("code", "n", (F.col("n") == F.col("highest")).alias("best"))


def link_scores(
    docs: DataFrame, a_path: str, b_path: str, id_column: str = "doc_id", text_column: str = "text",
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best (links whose pair is in as many documents as
    its A id's most frequent one), count_sum (the documents of the pair, over links), groups_sha256."""
    spark = docs.sparkSession
    aligned = stage(align_documents(docs, a_path, b_path, id_column, text_column), "aligned")
    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    counts = stage(pair_counts(aligned, b_size), "best-pairs")
    told = ["n_a", "n_b", "n_groups", "n_links"]
    if counts.count() <= broadcast_pairs:
        table = counts.toArrow().sort_by("code")
        shared = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("code", "n", "best")))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, n, best = shared.value
            for batch in batches:
                sums: list[list[int]] = [[], []]
                for packed in batch.column("links").to_pylist():
                    found, times = unpack_links(packed)
                    place = np.searchsorted(codes, found)
                    sums[0].append(int(times[best[place]].sum()))
                    sums[1].append(int((times * n[place]).sum()))
                kept = [c for c in batch.schema.names if c != "links"]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), *(pa.array(s, pa.int64()) for s in sums)], [*kept, "n_best", "count_sum"]
                )

        fields = ", ".join(f"{c} long" for c in told)
        scored = aligned.select("id", *told, "groups_sha256", "links").mapInArrow(
            score, f"id long, {fields}, groups_sha256 string, n_best long, count_sum long"
        )
    else:
        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, packed in enumerate(batch.column("links").to_pylist()):
                    found, times = unpack_links(packed)
                    places = [batch.column(c).take(pa.array(np.full(len(found), row))) for c in ("part", "position")]
                    yield pa.RecordBatch.from_arrays([*places, pa.array(found), pa.array(times)], ["part", "position", "code", "times"])

        links = aligned.select("part", "position", "links").mapInArrow(spread, "part int, position long, code long, times long")
        salted, hot = split_hot_keys(links, "code", ["part", "position"])
        met = salted.join(fan_out_hot_keys(counts, hot, "code"), ["code", "salt"])
        sums = met.groupBy("part", "position").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
        )
        scored = aligned.drop("links").join(sums, ["part", "position"], "left").na.fill(0, ["n_best", "count_sum"])
    return scored.select(F.col("id").alias(id_column), *told, "n_best", "count_sum", "groups_sha256")
