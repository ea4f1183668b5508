"""The registered queries of the subpackage against plain Python on whole small tables."""

import hashlib
import re
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SAID = "<|im_end|><|im_start|>assistant ok"


def run(spark, name):
    return __spark_entry__.queries()[name](spark, FOLDER).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_names_and_guard():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_|pipeline$", n)]
    numbers = sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in names


def test_token_counts(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = run(spark, "op1_token_counts")
    assert len(got) == len(docs)
    for r in got:
        n = len(tokenizer.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 1024)


def brute_components(docs, words, percent):
    sets = {}
    for d, text in docs.items():
        found = text.encode().lower().split()
        n = min(words, len(found))
        sets[d] = {tuple(found[i : i + n]) for i in range(len(found) - n + 1)} if found else set()
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    parent = {d: d for d in docs}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for d, s in sets.items():
        for e, n in Counter(e for x in s for e in holders[x] if e < d).items():
            if 100 * n >= percent * (len(s) + len(sets[e]) - n):
                a, b = root(d), root(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_near_duplicates(spark, docs):
    expected = brute_components(docs, 3, 85)
    got = run(spark, "op4_near_duplicates")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def base_of(text):
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
        len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words),
    )


def test_quality_rules(spark, docs):
    for r in run(spark, "op5_quality_rules"):
        base = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert base == base_of(docs[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_chat_format(spark):
    rows = spark.read.parquet(f"{FOLDER}/conversations.parquet").orderBy("conv_id", "turn").collect()
    turns = defaultdict(list)
    for r in rows:
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-1] = [("user", SAID), ("assistant", SAID)]
    got = {r.conv_id: r for r in run(spark, "op7_chat_format")}
    assert set(got) == set(turns)
    for conv, said in turns.items():
        loss = "".join(t for r, t in said if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(said), sha("".join(f"{a}\n{b}\n" for a, b in said)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        assert r.formatted_chars >= sum(len(b) for _, b in said)


def test_token_blocks(spark, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in run(spark, "op8_token_blocks")}
    start = 0
    for d in sorted(docs):
        ids = [*tokenizer.encode(docs[d], add_special_tokens=False).ids, 1]
        r = got[d]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(array("I", ids).tobytes()))
        start += len(ids)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text):
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    return {
        k: [(m.start(), m.end()) for m in re.finditer(p, text) if ok(m[0])] for k, (p, ok) in kinds.items()
    }


def test_private_data(spark, docs):
    for r in run(spark, "op9_private_data"):
        base = base_spans(docs[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(v) for v in base.values())
        listed = [f"{k}:{a}:{b}" for k, v in base.items() for a, b in v]
        assert r.base_sha256 == sha(",".join(listed))
        assert r.spans.split(",")[: len(listed)] == (listed or [r.spans.split(",")[0]][: len(listed)])


def contamination(text, items, width=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def words_of(t):
        return word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    words, hit, found = words_of(text), set(), set()
    for item, t in items:
        own = words_of(t)
        n = min(width, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(words)


def test_decontamination(spark, docs):
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for r in run(spark, "op10_decontamination"):
        got = (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
        assert got == contamination(docs[r.doc_id], items)


def test_main_text_of_whole_table(spark):
    got = run(spark, "op2_main_text")
    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        plain = " ".join(__import__("html").unescape(re.sub(r"<[^>]*>", " ", article)).split())
        assert " ".join(r.text.split()) == plain and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_source_mix(spark, docs):
    got = run(spark, "op6_source_mix")
    times = Counter(r.doc_id for r in got)
    assert set(times) == set(docs) and len({(r.doc_id, r.epoch) for r in got}) == len(got)
    held = defaultdict(int)
    own = defaultdict(int)
    for r in got:
        n = len(WORD.findall(docs[r.doc_id]))
        held[r.source] += n
        own[r.source] += n * (r.epoch == 0)
    total = sum(held.values())
    longest = max(len(t.split()) for t in docs.values())
    for r in got:
        assert abs(held[r.source] - r.weight * total) <= 2 * longest
        assert held[r.source] <= 2 * own[r.source]


def test_lm_scores(spark, docs):
    got = {r.doc_id: r for r in run(spark, "op3_lm_scores")}
    assert {d: r.n_tokens for d, r in got.items()} == {d: len(t.lower().split()) for d, t in docs.items()}
    assert all(r.pseudo_log_likelihood <= 0 for r in got.values())
