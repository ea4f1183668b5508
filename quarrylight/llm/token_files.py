"""Token ids in binary blocks: canonical length-limited Huffman codes from global counts.

Three steps. Texts become ids (end id appended) and are kept in the shared folder with the count of
every id over all documents. A code is made from those counts: lengths by package-merge, codes in
canonical order, so a file needs only the lengths. Documents are then dealt out by ranges of their id,
and every partition writes blocks in ascending order. A block holds whole documents, its bits, and the
bit offset of every `STRIDE`-th id; it is decoded alone, all its checkpoints side by side, with one
table lookup per id.

A dataset is two Parquet tables: `blocks` (part, block, first, doc_ids, lengths, n_ids, checkpoints,
payload; `first` is the number of ids before the block in its part) and `codebook` (token, bits).
`part` ascends with the document id.

Nulls: a null text is the empty text (only the end id); a null id is the smallest. Documents with equal
ids stay apart, in the order of their content. Empty tables give no blocks. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.tables import WHITE, bits_for, text_of
from quarrylight.llm.tokenizing import ODD, REMEMBERED_CHARS, load_tokenizer, special_strings, to_letters
from quarrylight.sources.staging import stage

STRIDE = 64
BLOCK_IDS = 1 << 18
MAX_BITS = 18
REMEMBERED = 1_600_000
IDS_SCHEMA = "id long, ids binary, n_ids long"
BLOCK_SCHEMA = (
    "part int, block int, first long, doc_ids array<bigint>, lengths array<bigint>, n_ids long, "
    "checkpoints binary, payload binary"
)
# The word pattern of the lower-casing vocabulary. Fixed value.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
RUN = regex.compile(f"[^{WHITE}]+")


class WordIds(dict):
    """The ids of a run of non-white characters, as little-endian unsigned integers of `code`'s width.

    White space ends every word and is dropped, so a text's ids are its runs' ids in order. Plain ASCII
    is lower-cased here, other runs go through the tokenizer's normaliser; words are merged by its model.
    What was met is remembered up to REMEMBERED entries, then forgotten.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = load_tokenizer(path)
        self.merge = self.tokenizer.model.tokenize
        self.specials = special_strings(self.tokenizer)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"

    def word(self, word: str) -> bytes:
        found = self.get(word)
        if found is None:
            found = array(self.code, [t.id for t in self.merge(to_letters(word))]).tobytes()
            self.keep(word, found)
        return found

    def keep(self, text: str, found: bytes) -> None:
        if len(text) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = found

    def __missing__(self, run: str) -> bytes:
        if run.isascii():
            text = run.lower()
            if text.isalpha():
                found = self.word(text)
                if text != run:
                    self.keep(run, found)
                return found
        else:
            text = self.tokenizer.normalizer.normalize_str(run)
        found = b"".join([self.word(w) for w in WORD.findall(text)])
        self.keep(run, found)
        return found

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.specials) or ODD.search(text):
            return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, text.split()))


def id_type(path: str) -> np.dtype:
    """Two bytes for an id where the vocabulary allows it, else four."""
    return np.dtype("<u2" if load_tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4")


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def encode_documents(docs: DataFrame, path: str, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """(id, ids, n_ids) of every document; ids as `id_type` says."""
    kind = id_type(path)
    end = np.array([end_id], kind).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                out = [words.ids(t) + end for t in part.column("text").to_pylist()]
                counts = pa.array([len(x) // kind.itemsize for x in out], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(out, pa.binary()), counts], ["id", "ids", "n_ids"]
                )

    source = docs.select(F.col(id_column).cast("long").alias("id"), text_of(text_column).alias("text"))
    return source.mapInArrow(encode, IDS_SCHEMA)


def id_counts(encoded: DataFrame, kind: np.dtype) -> DataFrame:
    """(token, n) over all documents: counted within tasks, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind))
            if len(found) > len(totals):
                totals = np.pad(totals, (0, len(found) - len(totals)))
            totals[: len(found)] += found
        seen = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(totals[seen])], ["token", "n"])

    return encoded.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits (package-merge) for positive counts."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    limit = max(limit, bits_for(n))
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    # Level by level: pairs of the level below are merged with the leaves. Only which entries are
    # packages is remembered; the first 2n-2 entries of the last level are then traced back.
    weights, is_package = leaves, [np.zeros(n, bool)]
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        place = np.argsort(both, kind="stable")
        weights = both[place]
        is_package.append(place >= n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for level in reversed(is_package):
        packages = int(level[:take].sum())
        lengths[: take - packages] += 1
        take = 2 * packages
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, token); lengths of 0 have no code."""
    codes = np.zeros(len(lengths), np.int64)
    code = previous = 0
    for token in np.lexsort((np.arange(len(lengths)), lengths)):
        bits = int(lengths[token])
        if bits:
            code <<= bits - previous
            codes[token], previous = code, bits
            code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(token, bits) for every window of the longest code's width."""
    width = int(lengths.max(initial=1))
    codes, used = canonical_codes(lengths), np.flatnonzero(lengths)
    tokens, bits = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    ordered = used[np.argsort(codes[used] << (width - lengths[used]))]
    spans = (1 << (width - lengths[ordered])).astype(np.int64)
    filled = int(spans.sum())
    tokens[:filled] = np.repeat(ordered, spans)
    bits[:filled] = np.repeat(lengths[ordered], spans)
    return tokens, bits, width


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """The bits of ids, first bit first, and the bit offset of every STRIDE-th id."""
    size = lengths[ids]
    ends = np.cumsum(size)
    starts = ends - size
    word, shift = starts >> 5, 64 - (starts & 31) - size
    window = codes[ids].astype(np.uint64) << shift.astype(np.uint64)
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros((total >> 5) + 2, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.diff(word, prepend=-1))
        sums = np.add.reduceat(window >> np.uint64(32), first)
        words[word[first]] += sums
        words[word[first] + 1] += np.add.reduceat(window & np.uint64(0xFFFFFFFF), first)
    payload = words.astype(">u4").tobytes()[: (total + 7) // 8]
    return payload, starts[::STRIDE].astype("<u8").tobytes()


def unpack(payload: bytes, checkpoints: bytes, n: int, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The n ids of a block: every checkpoint starts a lane, all lanes advance one id at a time."""
    tokens, bits, width = table
    raw = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
    windows = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
    out = np.zeros((STRIDE, len(at)), np.uint32)
    last = len(windows) - 1
    for step in range(STRIDE):
        seen = windows[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)
        place = seen >> np.uint32(32 - width)
        out[step] = tokens[place]
        at += bits[place]
    return out.T.reshape(-1)[:n]


def write_token_blocks(
    docs: DataFrame, folder: str, path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text",
    partitions: int | None = None,
) -> None:
    """Encode documents and write them to `folder` in ascending id order.

    The counts that reach the driver are one per vocabulary entry; so is the broadcast code.
    """
    spark = docs.sparkSession
    kind = id_type(path)
    encoded = stage(encode_documents(docs, path, end_id, id_column, text_column), "token-ids")
    counted = sorted((r.token, r.n) for r in id_counts(encoded, kind).collect())
    lengths = np.zeros((counted[-1][0] + 1) if counted else 1, np.int64)
    if counted:
        tokens, n = np.array(counted, np.int64).T
        lengths[tokens] = code_lengths(n)
    spark.createDataFrame(
        [(int(t), int(lengths[t])) for t in np.flatnonzero(lengths)], "token long, bits int"
    ).coalesce(1).write.parquet(f"{folder}/codebook")
    book = spark.sparkContext.broadcast((canonical_codes(lengths), lengths))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, first = TaskContext.get().partitionId(), 0, 0
        codes, sizes = book.value
        ids, names, counts, held = [], [], [], 0
        schema = pa.schema([
            ("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
            ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("checkpoints", pa.binary()),
            ("payload", pa.binary()),
        ])

        def block() -> pa.RecordBatch:
            payload, checkpoints = pack(np.frombuffer(b"".join(ids), kind), codes, sizes)
            row = [[part], [number], [first], [names], [counts], [held], [checkpoints], [payload]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for name, content in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids.append(content)
                names.append(name)
                counts.append(len(content) // kind.itemsize)
                held += counts[-1]
                if held >= BLOCK_IDS:
                    yield block()
                    first, number = first + held, number + 1
                    ids, names, counts, held = [], [], [], 0
        if names:
            yield block()

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id"), F.xxhash64("ids"), F.col("ids")]
    (
        encoded.select("id", "ids").repartitionByRange(n, F.col("id"), F.xxhash64("ids"))
        .sortWithinPartitions(*order).select("id", "ids")
        .mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(f"{folder}/blocks")
    )


def read_token_blocks(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """Documents of a dataset: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked, ids."""
    book = spark.read.parquet(f"{folder}/codebook").collect()
    lengths = np.zeros(max((r.token for r in book), default=0) + 1, np.int64)
    for r in book:
        lengths[r.token] = r.bits
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    # One row per part, so as many as the writer had tasks: ids before each part.
    before, total = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        before[r.part], total = total, total + r.n
    offsets = spark.sparkContext.broadcast(before)
    fields = "id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    tables: dict[str, tuple] = {}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "table" not in tables:
            tables["table"] = decode_table(shared.value)
        for batch in batches:
            for row in range(batch.num_rows):
                block = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                ids = unpack(block["payload"], block["checkpoints"], block["n_ids"], tables["table"])
                raw = memoryview(ids.astype("<u4").tobytes())
                counts = np.array(block["lengths"], np.int64)
                first = offsets.value[block["part"]] + block["first"]
                ends = np.cumsum(counts)
                cuts = [raw[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                columns = [
                    pa.array(block["doc_ids"], pa.int64()), pa.array(first + ends - counts),
                    pa.array(counts), pa.array([zlib.crc32(c) for c in cuts], pa.int64()),
                ]
                names = ["id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([bytes(c) for c in cuts], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return blocks.mapInArrow(decode, fields).withColumnRenamed("id", "doc_id")
