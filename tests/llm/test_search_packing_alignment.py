"""Ranked search, packing and token alignment against plain Python, and their odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from quarrylight.llm import alignment, packing, ranked_search
from quarrylight.llm.byte_level import byte_level_ids, merge_ranks, token_bytes

FOLDER = "/root/testdata/sf0.001"
A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, id int, part string, item_id string, score int, n int, shard string"
LONG = "a" * 30_000 + " <|endoftext|> " + " " * 3_000 + "Wort " * 4_000
TEXTS = [(1, "One two two."), (1, "One two two."), (2, "one  TWO three"), (3, None), (4, ""), (None, "two three"), (None, None),
         (5, LONG), (6, " \n\t"), (7, "漢字 <|endoftext|>\n\n x▁y"), (8, "<s> a b\r\n")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, 1, "x", "y", 2, 3, "z") for d, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs, items, k=10):
    """{item position: [(score, doc)]} for lists of (id, text)."""
    words = [(d, Counter(terms_of(t))) for d, t in docs]
    words = [(d, c) for d, c in words if c]
    n, length = len(words), sum(sum(c.values()) for _, c in words)
    df = Counter(t for _, c in words for t in c)
    found = []
    for _, text in items:
        scores = []
        for d, c in words:
            m, score = 25 + 75 * sum(c.values()) * n // length, 0
            for t in terms_of(text):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((score, d))
        found.append(sorted(scores, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k])
    return found


def test_ranked_search_query(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    expected = {i: found for (i, _), found in zip(items, brute_search(list(docs.items()), items), strict=True)}
    got = defaultdict(list)
    for r in sorted(__spark_entry__.queries()["op11_ranked_search"](spark, FOLDER).collect(), key=lambda r: (r.item_id, r.rank)):
        got[r.item_id].append((r.score, r.doc_id))
        assert r.rank == len(got[r.item_id])
    assert dict(got) == {i: f for i, f in expected.items() if f}


def zipf_texts(n, seed=1):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    return [(k, " ".join(rnd.choices(words, weights, k=rnd.randint(1, 60)))) for k in range(n)]


@pytest.mark.parametrize("limits", [{"shard_words": 1 << 22}, {"shard_words": 500}, {"query_limit": 30}])
def test_ranked_search_many_shards_and_rounds(spark, limits):
    """Results do not depend on shards or on rounds; ties go by document id whatever the input order."""
    texts = zipf_texts(600)
    texts += [(1000 - k, "w3 w50 w50") for k in range(40)]
    items = [(f"q{k}", t) for k, (_, t) in enumerate(zipf_texts(12, seed=2))] + [("ties", "w3 w50"), ("none", "absent"), ("empty", None)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id string, text string")
    index = ranked_search.build_index(frame, shard_words=limits.get("shard_words", 1 << 22))
    rows = ranked_search.search(index, asked, query_limit=limits.get("query_limit", 1000)).collect()
    got = {(r.item_id, r["rank"]): (r.score, r.doc_id) for r in rows}
    expected = {(i, n + 1): x for (i, _), f in zip(items, brute_search(texts, items), strict=True) for n, x in enumerate(f)}
    assert got == expected


def test_ranked_search_skips_blocks():
    """A rare term fills the heap; most blocks of the frequent terms are then never decompressed."""
    rnd = np.random.default_rng(3)
    numbers, terms = ranked_search.Numbers(), []
    for k in range(40_000):
        words = ["the"] + (["of"] if k % 2 else []) + (["rare"] * 5 if k % 997 == 0 else []) + [f"x{rnd.integers(50)}"]
        terms.append(np.array([numbers[w.encode()] for w in words]))
    sizes = np.array([len(t) for t in terms], np.int64)
    length = int(sizes.sum())
    rows = {bytes(r["term"]): r for r in ranked_search.invert("s", terms, numbers, sizes, len(terms), length).to_pylist()}

    def lists():
        return [ranked_search.PostingList(w, *(rows[t][c] for c in ("top", "lasts", "places", "tops", "postings")))
                for t, w in ((b"the", 3), (b"of", 400), (b"rare", 6000))]

    work = ranked_search.Work()
    heap = ranked_search.search_shard(lists(), sizes, 5, len(terms), length, work)
    scores = np.zeros(len(terms), np.int64)
    for one in lists():
        found, tf = one.read(np.arange(len(one.lasts)))
        scores[found] += one.weight * ranked_search.score_parts(tf, sizes[found], len(terms), length)
    best = np.lexsort((np.arange(len(scores)), -scores))[:5]
    assert sorted((-s, -d) for s, d in heap.rows) == [(-int(scores[d]), int(d)) for d in best]
    assert work.read * 3 < work.blocks


def test_numbers_round_trip():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2**21, 2**28, 2**35 - 1, 5], np.int64)
    raw, places = ranked_search.encode_numbers(values)
    assert (ranked_search.decode_numbers(raw) == values).all() and places[0] == 0


def test_ranked_search_odd_rows(spark, odd, none):
    items = [(None, "two"), ("a", None), ("a", "three"), ("a", "three"), ("a", "one wort"), ("", "two")]
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, doc_id int")
    rows = ranked_search.search(ranked_search.build_index(odd), asked).collect()
    different = list(dict.fromkeys(items))
    expected = [(i, n + 1, d, s) for (i, _), f in zip(different, brute_search(TEXTS, different), strict=True) for n, (s, d) in enumerate(f)]
    key = str
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=key) == sorted(expected, key=key)
    assert ranked_search.search(ranked_search.build_index(none), asked).count() == 0
    assert ranked_search.search(ranked_search.build_index(odd), asked.limit(0)).count() == 0


@lru_cache
def library(plain):
    tokenizer = Tokenizer.from_file(A_PATH)
    tokenizer.encode_special_tokens = plain
    return tokenizer


def ids_of(text, plain=False):
    return library(plain).encode(text or "", add_special_tokens=False).ids


def test_byte_level_ids_equal_the_library():
    rnd = random.Random(5)
    letters = "ab  \n\t\r'sdtTrevl19.,!<|>é́ñ漢　\x1c\x85​😀٣Ⅷ²\x00"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 20))) for _ in range(3000)] + [t for _, t in TEXTS if t] + [" \n" * 5000]
    assert merge_ranks(A_PATH) is not None
    for plain in (False, True):
        found = byte_level_ids(A_PATH, plain)
        tokenizer = Tokenizer.from_file(A_PATH)
        tokenizer.encode_special_tokens = plain
        assert [found.ids(t) for t in texts] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def check_packed(rows, texts, size, end_id):
    """Every id of every document once, sequences gapless; returns sequence -> length."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    expected = defaultdict(list)
    for d, t in texts:
        ids = [*ids_of(t), end_id]
        expected[d, len(ids)].append(np.array(ids, "<u4").tobytes())
    for key, contents in expected.items():
        pieces = by_doc.pop(key)
        assert sum(p.length for p in pieces) == key[1] * len(contents)
        wanted = Counter(c[4 * p.start : 4 * (p.start + p.length)] for c in set(contents) for p in pieces)
        assert set(bytes(p.ids) for p in pieces) <= set(wanted)
        covered = Counter(k for p in pieces for k in range(p.start, p.start + p.length))
        assert set(covered.values()) == {len(contents)} and len(covered) == key[1]
    assert not by_doc
    lengths = {}
    for s, found in by_sequence.items():
        at = 0
        for offset, length in sorted(found):
            assert offset == at and length > 0
            at += length
        lengths[s] = at
    assert sorted(lengths) == list(range(len(lengths)))
    assert all(n == size or (n < size and n & (n - 1) == 0) for n in lengths.values())
    assert sum(n < size for n in lengths.values()) <= math.log2(size)
    return lengths


@pytest.mark.parametrize("limit", [packing.BROADCAST_COUNTS, 0])
def test_packing_odd_rows(spark, odd, none, limit):
    packed = packing.pack_documents(odd.repartition(3, "text"), A_PATH, 1, size=64, broadcast_counts=limit)
    rows = packed.collect()
    lengths = check_packed(rows, TEXTS, 64, 1)
    made = packing.sequences(packed, 64).collect()
    assert {r.sequence_id: r.n_ids for r in made} == lengths and all(len(r.ids) == 4 * r.n_ids for r in made)
    assert all(r.padded_length == r.n_ids for r in made)
    assert packing.pack_documents(none, A_PATH, 1).count() == 0


def test_packing_query(spark, docs):
    rows = __spark_entry__.queries()["op12_packing"](spark, FOLDER).collect()
    ids = {d: np.array([*ids_of(t), 1], "<u4").tobytes() for d, t in docs.items()}
    covered, sequences = Counter(), defaultdict(list)
    for r in rows:
        piece = ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert len(piece) == 4 * r.length and zlib.crc32(piece) == r.ids_crc32 and r.doc_tokens * 4 == len(ids[r.doc_id])
        covered.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert max(covered.values()) == 1 and len(covered) == sum(map(len, ids.values())) // 4
    totals = [sum(n for _, n in s) for s in sequences.values()]
    for s in sequences.values():
        assert all(o == sum(n for p, n in s if p < o) for o, _ in s)
    assert sum(n != 2048 for n in totals) <= 11 and all(n & (n - 1) == 0 and n <= 2048 for n in totals)


def fullest(counts, capacity):
    """The largest sum up to the capacity, by trying every multiset."""
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= capacity}
    return max(sums)


def test_closest_fill_is_the_best_multiset():
    rnd = random.Random(11)
    for _ in range(300):
        counts = {rnd.randint(1, 40): rnd.randint(1, 6) for _ in range(rnd.randint(0, 6))}
        capacity = rnd.randint(0, 90)
        chosen = packing.closest_fill(counts, capacity)
        assert sum(x * n for x, n in chosen.items()) == fullest(counts, capacity)
        assert all(0 < n <= counts[x] for x, n in chosen.items())


@pytest.mark.parametrize("counts", [{1500: 3000}, {2047: 400, 2046: 50}, {1: 5}, {2048: 3}, {}, {7: 1000, 1999: 900, 30: 11}])
def test_plan_places_every_piece_once(counts):
    plan = packing.plan_sequences(counts)
    places, sequences = packing.Places(plan), defaultdict(list)
    for length, n in counts.items():
        for rank in range(n):
            parts = list(places.of(length, rank))
            assert sum(p[0] for p in parts) == length
            for take, sequence, offset in parts:
                sequences[sequence].append((offset, take))
    assert sorted(sequences) == list(range(plan.sequences))
    for parts in sequences.values():
        at = 0
        for offset, take in sorted(parts):
            assert offset == at
            at += take
        assert at == 2048 or (at < 2048 and at & (at - 1) == 0)


def brute_alignment(texts):
    """The contract of the alignment query, token by token."""
    model, a_bytes = sentencepiece.SentencePieceProcessor(model_file=B_PATH), token_bytes(A_PATH)

    def b_piece(number):
        piece = model.id_to_piece(number)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    rows, holders = [], defaultdict(set)
    for row, text in enumerate(texts):
        a = ids_of(" " + text, plain=True) if text else []
        b = model.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if b"".join(a_bytes[x] for x in a) != raw or b"".join(b_piece(x) for x in b) != raw:
            a = b = []
        spans = []
        for side, size in ((a, lambda x: len(a_bytes[x])), (b, lambda x: len(b_piece(x)))):
            at, found = 0, []
            for x in side:
                found.append((x, at, at + size(x)))
                at += size(x)
            spans.append(found)
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(x) for x, s, e in side if low < e <= cut) for side in spans))
            low = cut
        links, j = [], 0
        for x, s, e in spans[0]:
            while j < len(b) and spans[1][j][2] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][1] < e:
                links.append((x, spans[1][k][0]))
                k += 1
        for link in links:
            holders[link].add(row)
        rows.append((len(a), len(b), groups, links))
    best = Counter()
    for (x, _), held in holders.items():
        best[x] = max(best[x], len(held))
    return [
        (n_a, n_b, len(groups), len(links), sum(len(holders[x]) == best[x[0]] for x in links), sum(len(holders[x]) for x in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "")
        for n_a, n_b, groups, links in rows
    ]


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_query(spark, docs):
    ids = sorted(docs)
    expected = dict(zip(ids, brute_alignment([docs[d] for d in ids]), strict=True))
    got = __spark_entry__.queries()["op13_token_alignment"](spark, FOLDER).collect()
    assert {r.doc_id: tuple(r[f] for f in FIELDS) for r in got} == expected and len(got) == len(ids)


@pytest.mark.parametrize("limit", [alignment.BROADCAST_PAIRS, 0])
def test_alignment_odd_rows(spark, odd, none, limit):
    got = alignment.link_scores(odd.repartition(3), A_PATH, B_PATH, broadcast_pairs=limit).collect()
    expected = [(d, *row) for (d, _), row in zip(TEXTS, brute_alignment([t for _, t in TEXTS]), strict=True)]
    assert sorted(((r.doc_id, *(r[f] for f in FIELDS)) for r in got), key=str) == sorted(expected, key=str)
    assert alignment.link_scores(none, A_PATH, B_PATH, broadcast_pairs=limit).count() == 0


def test_alignment_groups_text(spark):
    text = "Whitespace anchors, naïvely 漢字\n\ttried."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = alignment.align_documents(docs, A_PATH, B_PATH, with_groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 == brute_alignment([text])[0][-1]
    codes, times = alignment.unpack_links(row.links)
    assert int(times.sum()) == row.n_links and (np.diff(codes) > 0).all()


def test_window_memory_is_bounded_and_long_windows_are_not_kept():
    pair = alignment.Aligner(A_PATH, B_PATH)
    found = pair.align("x" + "é" * 500)
    assert found.n_groups > 0 and not any(len(k) > pair.windows.kept_bytes for k in pair.windows)
    pair.align("two words two words")
    assert len(pair.windows) == 2


def test_sequence_length(spark):
    rows = spark.createDataFrame([(1,), (1024,), (1500,), (2048,)], "n long").select(packing.sequence_length(F.col("n")).alias("p")).collect()
    assert [r.p for r in rows] == [1, 1024, 2048, 2048]
