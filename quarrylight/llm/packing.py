"""Packing documents into sequences by minimum bin slack.

Three steps. Documents become ids (end id appended) in the shared folder; a document of more than `size` ids is
cut into full sequences and a tail. Then only lengths matter: the number of pieces of each length, `size`
numbers at most however large the corpus, reaches the driver, where sequences are planned. A sequence starts
with the longest piece left; a bitset of reachable sums picks the multiset of other lengths that fills it
closest to the capacity, the counts are traced back, and the pattern is applied as often as the counts allow.
Where no multiset fills a sequence, one more piece is cut at the gap and its rest is packed like any other.
What is left in the end is less than one sequence and is cut at powers of two, which need no padding. Last,
pieces find their place by arithmetic: the n-th piece of a length belongs to the n-th slot of that length.
Pieces are numbered within the task that wrote them, plus what the tasks before it counted, so no task sees
all pieces of a frequent length.

Nulls: a null text counts as empty and is its end id alone; a null id stays null. An empty table gives an
empty result. Rows that repeat an id or a text are packed each. Texts of any length are packed whole. Other
columns stay out.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.byte_level import byte_level_ids
from quarrylight.llm.tables import text_of
from quarrylight.sources.staging import stage

SIZE = 2048
#: (task, length) counts that are broadcast; beyond that they are joined by task.
BROADCAST_COUNTS = 500_000
ENCODED_SCHEMA = "part int, id long, ids binary, n_ids long, full_rank long, tail_rank long"
PIECE_SCHEMA = "id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


@dataclass
class Run:
    """Slots for pieces of one length: `copies` side by side in each of `times` sequences.

    Pieces of rank `first` on lie in sequences `sequence` on, from `offset`. Only the first `take` ids of a
    piece lie there; the rest is the piece of rank `rest_rank` on among those of the remaining length.
    """

    first: int
    copies: int
    sequence: int
    offset: int
    take: int
    rest_rank: int = 0


@dataclass
class Plan:
    runs: dict[int, list[Run]] = field(default_factory=lambda: defaultdict(list))
    sequences: int = 0


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to `capacity`: length -> copies.

    Bit s of `reach` tells that sum s can be made. Copies are offered in groups of 1, 2, 4, ...; a group is
    traced back only if the sum cannot be made without it, so longer pieces, offered first, are preferred.
    """
    reach, within, offered = 1, (1 << (capacity + 1)) - 1, []
    for length in sorted((x for x in counts if x <= capacity and counts[x] > 0), reverse=True):
        left, group = min(counts[length], capacity // length), 1
        while left > 0:
            n = min(group, left)
            offered.append((length, n, reach))
            reach |= (reach << (length * n)) & within
            left, group = left - n, group * 2
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, Counter()
    for length, n, before in reversed(offered):
        if not before >> total & 1:
            chosen[length] += n
            total -= length * n
    return dict(chosen)


def plan_sequences(counts: dict[int, int], size: int = SIZE) -> Plan:
    """Slots for `counts[length]` pieces of every length up to `size`. Every sequence is full, but for
    the last ones, whose lengths are falling powers of two."""
    plan, left = Plan(), Counter({x: n for x, n in counts.items() if n > 0})
    made, used = Counter(left), Counter()

    def put(length: int, copies: int, times: int, offset: int, take: int) -> None:
        rest = length - take
        plan.runs[length].append(Run(used[length], copies, plan.sequences, offset, take, made[rest]))
        used[length] += copies * times
        left[length] -= copies * times
        if not left[length]:
            del left[length]
        if rest:
            made[rest] += times
            left[rest] += times

    total = sum(x * n for x, n in left.items())
    while total >= size:
        pattern = Counter({max(left): 1})
        longest = max(left)
        pattern.update(closest_fill(left - pattern, size - longest))
        gap = size - sum(x * n for x, n in pattern.items())
        need = Counter(pattern)
        cut = 0
        if gap:
            # No multiset fills the sequence, so a longer piece is left (else everything left would fit).
            cut = max((left - pattern))
            need[cut] += 1
        times = min(left[x] // n for x, n in need.items())
        offset = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            put(length, copies, times, offset, length)
            offset += length * copies
        if gap:
            put(cut, 1, times, offset, gap)
        plan.sequences += times
        total -= size * times
    open_size = held = 0
    while left:
        if held == open_size:
            plan.sequences += open_size > 0
            open_size, held = 1 << (total.bit_length() - 1), 0
        length = max(left)
        take = min(length, open_size - held)
        put(length, 1, 1, held, take)
        held, total = held + take, total - take
    plan.sequences += open_size > 0
    return plan


class Places:
    """Where a piece lies, by its length and rank."""

    def __init__(self, plan: Plan):
        self.firsts = {x: np.array([r.first for r in runs], np.int64) for x, runs in plan.runs.items()}
        self.runs = plan.runs

    def of(self, length: int, rank: int) -> Iterator[tuple[int, int, int]]:
        """(ids, sequence, offset) of the parts of a piece, in order."""
        while length:
            run = self.runs[length][int(np.searchsorted(self.firsts[length], rank, "right")) - 1]
            ahead, copy = divmod(rank - run.first, run.copies)
            yield run.take, run.sequence + ahead, run.offset + copy * length
            length, rank = length - run.take, run.rest_rank + ahead


def encode_for_packing(docs: DataFrame, path: str, end_id: int, size: int, id_column: str, text_column: str) -> DataFrame:
    """Per document: part (the task that wrote it), ids, and its pieces' ranks within the part: of the
    first full piece among full ones, of the tail among tails of its length."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, seen = byte_level_ids(path).ids, TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                rows = batch.slice(start, 1000)
                ids, n_ids, full, tails = [], [], [], []
                for text in rows.column("text").to_pylist():
                    found = ids_of(text)
                    found.append(end_id)
                    ids.append(np.array(found, "<u4").astype(kind, copy=False).tobytes())
                    n_ids.append(len(found))
                    whole, tail = divmod(len(found), size)
                    full.append(seen[size])
                    seen[size] += whole
                    tails.append(seen[tail])
                    seen[tail] += tail > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * rows.num_rows, pa.int32()), rows.column("id"), pa.array(ids, pa.binary()),
                     pa.array(n_ids, pa.int64()), pa.array(full, pa.int64()), pa.array(tails, pa.int64())],
                    ["part", "id", "ids", "n_ids", "full_rank", "tail_rank"],
                )

    kind = narrow_type(path, end_id)
    source = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    return source.mapInArrow(encode, ENCODED_SCHEMA)


def narrow_type(path: str, end_id: int) -> np.dtype:
    """Two bytes for an id where the vocabulary allows it, else four."""
    size = byte_level_ids(path).tokenizer.get_vocab_size()
    return np.dtype("<u2" if max(size, end_id + 1) <= 1 << 16 else "<u4")


def length_counts(encoded: DataFrame, size: int) -> DataFrame:
    """(part, length, n): the pieces of every length each part holds."""
    full, tail = F.floor(F.col("n_ids") / size).cast("long"), (F.col("n_ids") % size).cast("long")
    pieces = F.array(F.struct(F.lit(size).cast("long").alias("length"), full.alias("n")), F.struct(tail.alias("length"), F.lit(1).cast("long").alias("n")))
    listed = encoded.select("part", F.inline(pieces)).where("length > 0 and n > 0")
    return listed.groupBy("part", "length").agg(F.sum("n").alias("n"))


def pack_documents(
    docs: DataFrame, path: str, end_id: int, size: int = SIZE, id_column: str = "doc_id", text_column: str = "text",
    broadcast_counts: int = BROADCAST_COUNTS,
) -> DataFrame:
    """Per piece: doc_id, start (its document's ids before it), length, doc_tokens, sequence_id, offset in
    the sequence, ids (little-endian unsigned 32-bit). `path` names a byte-level tokenizer file on every node.

    The ids are written once and read once, without a shuffle. The counts before each part go out with the
    plan while there are at most `broadcast_counts` of them; beyond that they meet the ids in a join by part.
    """
    spark = docs.sparkSession
    kind = narrow_type(path, end_id)
    encoded = stage(encode_for_packing(docs, path, end_id, size, id_column, text_column), "packing-ids")
    counts = stage(length_counts(encoded, size), "packing-counts")
    # One row per length, so `size` rows at most.
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(plan_sequences(totals, size))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    few = counts.count() <= broadcast_counts

    def with_rank(df: DataFrame, length: Column, name: str) -> DataFrame:
        """df with `name` counted over all parts: what the parts before a row's own hold of `length` is added."""
        known = before.select(F.col("part"), F.col("length").alias("of_length"), F.col("before").alias("earlier_parts"))
        ranked = df.withColumn("of_length", length).join(F.broadcast(known) if few else known, ["part", "of_length"], "left")
        whole = F.col(name) + F.coalesce("earlier_parts", F.lit(0))
        return ranked.withColumn(name, whole).drop("of_length", "earlier_parts")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(plan.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                rows = batch.slice(start, 1000).to_pydict()
                out: dict[str, list] = {c: [] for c in ("id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")}
                for name, content, n, full, tail in zip(*(rows[c] for c in ("id", "ids", "n_ids", "full_rank", "tail_rank")), strict=True):
                    raw, at = np.frombuffer(content, kind).astype("<u4").tobytes(), 0
                    pieces = [(size, full + p) for p in range(n // size)] + [(n % size, tail)]
                    for length, rank in pieces:
                        for take, sequence, offset in places.of(length, rank):
                            row = (name, at, take, n, sequence, offset, raw[4 * at : 4 * (at + take)])
                            for column, value in zip(out.values(), row, strict=True):
                                column.append(value)
                            at += take
                types = [pa.int64()] * 6 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], list(out))

    ranked = with_rank(encoded, F.lit(size).cast("long"), "full_rank")
    ranked = with_rank(ranked, (F.col("n_ids") % size).cast("long"), "tail_rank")
    placed = ranked.select("id", "ids", "n_ids", "full_rank", "tail_rank").mapInArrow(place, PIECE_SCHEMA)
    return placed.withColumnRenamed("id", id_column)


def sequence_length(total: Column, size: int = SIZE) -> Column:
    """The padded length of a sequence that holds `total` ids: a power of two stays."""
    return F.when(F.bit_count(total) == 1, total).otherwise(F.lit(size).cast("long"))


def sequences(packed: DataFrame, size: int = SIZE) -> DataFrame:
    """Packed pieces as training rows: sequence_id, ids (bytes, in order), n_ids, padded_length, n_pieces.

    A group is one sequence, so it holds at most `size` pieces."""
    grouped = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"), F.sum("length").alias("n_ids")
    )
    return grouped.select(
        "sequence_id", F.aggregate("pieces", F.lit(b""), lambda done, piece: F.concat(done, piece["ids"])).alias("ids"),
        "n_ids", sequence_length(F.col("n_ids"), size).alias("padded_length"), F.size("pieces").alias("n_pieces"),
    )
