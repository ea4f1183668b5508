"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import math
import random
import textwrap
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from quarrylight.llm import chat_format, language_model, private_data, source_mixing, token_files
from quarrylight.llm.decontamination import benchmark_hits, decontaminate
from quarrylight.llm.main_text import extract_main_text, main_text
from quarrylight.llm.near_duplicates import Link, near_duplicates, shingle_set
from quarrylight.llm.quality_rules import quality_rules
from quarrylight.llm.token_counts import token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, row string, id int, value int"
PROSE = " ".join(f"word{i} and another{i}" for i in range(60)) + "."
LONG = "a" * 50_000 + "@" + "1 " * 20_000 + "+" + "." * 5_000
TEXTS = [(1, PROSE), (1, PROSE), (2, PROSE + " end"), (3, None), (4, ""), (None, PROSE), (None, None), (5, LONG), (6, " \n\t"), (7, "a b")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(d, t, None, None if d == 2 else "s", None, "x", "y", 1, 2) for d, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = token_counts(odd, path).collect()
    assert len(rows) == len(TEXTS) and {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {0}
    assert token_counts(none, path).count() == 0


def test_near_duplicates(odd, none):
    rows = near_duplicates(odd, Link(words=3, percent=85)).collect()
    found = sorted((str(r.doc_id), r.n_shingles > 0, r.component_id, r.kept) for r in rows)
    assert found.count(("1", True, 1, True)) == 2 and ("2", True, 1, False) in found
    assert ("3", False, 3, True) in found and ("None", True, None, True) in found and len(found) == len(TEXTS)
    assert near_duplicates(none, Link()).count() == 0


def test_a_worker_keeps_no_words_of_texts_it_has_hashed():
    text = " ".join(f"word{i}" for i in range(200_000))
    tracemalloc.start()
    assert len(shingle_set(text, 3)) == 199_998
    kept, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 2_000_000


def test_chain_of_copies_is_one_component(spark):
    words = [f"w{i}" for i in range(400)]
    texts = [(n, " ".join(words[: 300 + 8 * n])) for n in range(10)]
    docs = spark.createDataFrame(texts + [(99, "other words only here")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, Link(words=3, percent=95)).collect()}
    assert got == {n: 0 for n in range(10)} | {99: 99}


def test_quality_rules(odd, none):
    rows = quality_rules(odd).collect()
    assert len(rows) == len(TEXTS) and all(r.base_failed and not r.kept for r in rows if r.row.doc_id in (3, 4, 6, 7))
    assert all(r.kept and r.cleaned == r.row.text for r in rows if r.row.doc_id in (1, 2) and r.row.text == PROSE)
    assert quality_rules(none).where("kept").count() == 0


def test_quality_rules_drop_failing_lines(spark):
    menu = "Home | News | Sport | Mail | Shop | Help"
    docs = spark.createDataFrame([(1, f"{PROSE}\n{menu}\nAll rights reserved."), (2, "\n".join([menu] * 30))], "doc_id long, text string")
    rows = {r.row.doc_id: r for r in quality_rules(docs).collect()}
    assert rows[1].kept and rows[1].cleaned == PROSE and rows[1].n_failed_lines == 2 and not rows[2].kept


def judged(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.row.doc_id: r for r in quality_rules(docs).collect()}


def test_quality_rules_keep_wrapped_prose_headings_and_lists(spark):
    words = [" ".join(f"word{n}{i} goes with{i} thing{n}" for i in range(30)) for n in range(3)]
    wrapped = "\n".join(textwrap.wrap(f"{words[0]}. {words[1]}! Was {words[2]}?", 72))
    scripts = ["\n".join(f"{w}{end}" for w in words) for end in ("।", "؟", "۔", "。”")]
    headed = f"A title\n\nThe first part\n\n{wrapped}\n\nWhat it takes\n\n- two eggs\n- some flour\n\nAnd more:\nsalt\nwater\n\n{PROSE}"
    menu = "\n".join(f"Entry {i} of this long menu" for i in range(30))
    rows = judged(spark, [wrapped, *scripts, headed, f"{PROSE}\n\n{menu}", f"{menu}\n\n{PROSE[:300]}."])
    for n in range(6):
        assert rows[n].kept and rows[n].n_failed_lines == 0 and rows[n].cleaned == rows[n].row.text, n
    assert rows[6].n_failed_lines == rows[7].n_failed_lines == 30 and not rows[7].kept


def test_quality_rules_keep_prose_that_holds_a_phrase(spark):
    words = [" ".join(f"word{n}{i} goes with{i} thing{n}" for i in range(30)) for n in range(2)]
    one = f"{words[0]}, a car powered by steam, {words[1]}. You can read more in it."
    wrapped = "\n".join(textwrap.wrap(one, 60))
    embedded = f"{PROSE}\nUnlicensed undertakings, empowered bystanders."
    notices = f"{PROSE}\nAll rights reserved.\nThis work is licensed under the GNU General Public License, version 3."
    rows = judged(spark, [one, wrapped, embedded, notices])
    for n in range(3):
        assert rows[n].kept and rows[n].n_failed_lines == 0 and rows[n].cleaned == rows[n].row.text, n
    assert rows[3].n_failed_lines == 2 and rows[3].cleaned == PROSE


def test_private_data(odd, none, spark):
    assert private_data.find_private_data(odd).count() == len(TEXTS)
    assert private_data.find_private_data(none).where("size(spans) > 0").count() == 0
    text = "IBAN DE89 3704 0044 0532 0130 00, DE88370400440532013000; a@b.c+d@e.f; 1.2.3.4.5; 4111 1111 1111 1111; +49 (30) 1234567."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = private_data.masked(private_data.find_private_data(docs)).first()
    assert [s.kind for s in found.spans] == ["email", "email", "ip", "card", "phone", "iban"]
    assert all(text[s.start : s.end] == s.text for s in found.spans)
    assert found.masked == "IBAN [iban], DE88370400440532013000; [email][email]; [ip].5; [card]; [phone]."


def test_accounts_before_capitals(spark):
    account, spaced = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    texts = [f"IBAN: {account} BIC: COBADEFFXXX", f"IBAN {spaced} BIC", f"account {account} I paid", f"bank {spaced} 42 EUR GB82 WEST 1234 5698 7654 32 NOW"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.row.doc_id: [s.text for s in r.spans if s.kind == "iban"] for r in private_data.find_private_data(docs).collect()}
    assert found == {0: [account], 1: [spaced], 2: [account], 3: [spaced, "GB82 WEST 1234 5698 7654 32"]}


def test_decontamination(odd, none, spark):
    items = spark.createDataFrame([(None, PROSE[:300]), ("a,b", "a B"), ("x", None)], "item_id string, text string")
    rows = benchmark_hits(odd, items).collect()
    assert len(rows) == len(TEXTS) and all(r.contaminated for r in rows if r.doc_id in (1, 2, 7))
    assert {r.n_hit for r in rows if r.doc_id in (3, 4, 6)} == {0}
    split = benchmark_hits(odd, items, broadcast_words=1).collect()
    assert sorted(map(str, split)) == sorted(map(str, rows))
    left = decontaminate(odd, items)
    assert left.columns == odd.columns and {r.doc_id for r in left.collect()} == {3, 4, 5, 6, None}
    assert benchmark_hits(none, items).count() == 0
    assert not any(r.contaminated for r in benchmark_hits(odd, items.where("false")).collect())


def test_source_mixing(odd, none):
    rows = source_mixing.mix_sources(odd).collect()
    assert len([r for r in rows if r.epoch == 0]) == len(TEXTS) and source_mixing.mix_sources(none).count() == 0
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    flat = source_mixing.solve_exponent(shares, None, 2.0)
    assert math.isclose(source_mixing.repeats(shares, source_mixing.tempered(shares, flat)), 2.0, rel_tol=1e-9)
    part = source_mixing.solve_exponent(shares, 0.9, None)
    assert math.isclose(source_mixing.entropy(source_mixing.tempered(shares, part)), 0.9 * math.log(3), rel_tol=1e-9)


def test_chat_events(spark):
    schema = "conv_id long, seq long, kind string, message_id long, role string, text string"
    log = [
        (1, 1, "message", 1, "user", "hi <|im_end|> \\ x"), (1, 2, "delta", 2, "assistant", "Hel"), (1, 3, "delta", 2, None, "lo"),
        (1, 4, "message", 3, "user", "again"), (1, 5, "regenerate", 2, None, None), (1, 6, "delta", 2, None, "Bye"),
        (1, 7, "edit", 1, None, "hey"), (2, 1, None, 1, "a\nb", None), (None, 1, "message", 1, "assistant", "y"),
    ]
    events = spark.createDataFrame(log, schema)
    rows = {r.conv_id: r for r in chat_format.parse_chats(chat_format.format_chats(events)).collect()}
    assert [tuple(t) for t in rows[1].turns] == [("user", "hey"), ("assistant", "Bye")] and rows[1].loss_texts == ["Bye"]
    assert [tuple(t) for t in rows[2].turns] == [("a\nb", "")] and rows[None].loss_texts == ["y"]
    assert chat_format.format_chats(events.where("false")).count() == 0


def test_token_blocks(odd, none, spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    for name, docs in (("odd", odd), ("none", none)):
        token_files.write_token_blocks(docs, f"{tmp_path}/{name}", path, 1)
    rows = sorted(token_files.read_token_blocks(spark, f"{tmp_path}/odd").collect(), key=lambda r: r.start)
    ends = np.cumsum([r.n_tokens for r in rows])
    assert [r.start for r in rows] == [0, *ends[:-1].tolist()] and len(rows) == len(TEXTS)
    assert [r.doc_id for r in rows] == [None, None, 1, 1, 2, 3, 4, 5, 6, 7]
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 6)} == {1}
    assert token_files.read_token_blocks(spark, f"{tmp_path}/none").count() == 0


def test_huffman_round_trip_and_limit():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 5000), 900).astype(np.uint32)
    counts = np.bincount(ids).astype(np.int64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    lengths[used] = token_files.code_lengths(counts[used], 11)
    assert lengths.max() <= 11 and sum(2.0 ** -lengths[used]) <= 1
    payload, marks = token_files.pack(ids, token_files.canonical_codes(lengths), lengths)
    assert (token_files.unpack(payload, marks, len(ids), token_files.decode_table(lengths)) == ids).all()


def test_model_learns_and_scores_exactly(spark, none, odd):
    shape = language_model.Shape(classes=4, per_class=8, buckets=8, hidden=8, batch=512)
    draw = random.Random(3)
    pairs = [("red", "fox"), ("blue", "sky"), ("old", "man"), ("big", "dog")]
    texts = [(n, " ".join(w for _ in range(40) for w in draw.choice(pairs))) for n in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    model = language_model.train_model(docs, shape, rounds=2)
    right = [(1, "red fox blue sky old man big dog " * 5), (2, "fox red sky blue man old dog big " * 5)]
    held = spark.createDataFrame(right, "doc_id long, text string")
    scores = {r.doc_id: r for r in language_model.score_documents(held, model, shape).collect()}
    assert scores[1].mean_log_probability > scores[2].mean_log_probability + 0.5
    numbers = language_model.Numbers(model[0], shape)
    row, at = language_model.padded([np.array([numbers[w] for w in right[0][1].split()])], shape)
    whole = 0.0
    for p in at:  # one token at a time, over all tokens: probabilities sum to one
        each = []
        for t in range(shape.tokens):
            other = row.copy()
            other[p] = t
            each.append(language_model.log_probabilities(other, np.array([p]), model[1], shape)[0])
        assert math.isclose(sum(map(math.exp, each)), 1.0, rel_tol=1e-4)
        whole += each[row[p]]
    assert math.isclose(whole, scores[1].pseudo_log_likelihood, rel_tol=1e-4)
    assert language_model.score_documents(none, model, shape).count() == 0
    assert {r.mean_log_probability for r in language_model.score_documents(odd, model, shape).collect() if r.doc_id in (3, 4)} == {None}


def test_every_word_has_its_own_probability(spark):
    assert language_model.least_count(10_000) < language_model.least_count(100_000_000)
    assert language_model.shape_for(8_000).words >= 8_000
    shape = language_model.Shape(classes=2, middle=2, per_class=3, buckets=8, hidden=4, reach=2, batch=64)
    draw = random.Random(5)
    texts = [(n, " ".join(f"w{int(draw.paretovariate(0.7)) % 200}" for _ in range(50))) for n in range(60)] + [(60, ""), (60, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    counts = Counter(w for _, t in texts for w in (t or "").split())
    for known in (20, 1000):
        model = language_model.train_model(docs, shape, known=known)
        assert len(model.listed) == 4 and (model.rare is None) == (known == 1000)
        numbers, others = language_model.Numbers(model.listed, shape), Counter()
        for w, n in counts.items():
            others[numbers[w]] += n * (w not in model.listed)
        held = spark.createDataFrame(texts + [(70, "w1 never w150 w1")], "doc_id long, text string")
        got = {r.doc_id: r.pseudo_log_likelihood for r in language_model.score_documents(held, model).collect()}
        assert len(got) == 62
        for d, text in [*texts[:60], (70, "w1 never w150 w1")]:
            row, at = language_model.padded([np.array([numbers[w] for w in text.split()])], shape)
            whole = sum(language_model.log_probabilities(row, at, model.weights, shape).tolist())
            whole += sum(math.log(counts.get(w, 1) / (others[numbers[w]] + 1)) for w in text.split() if w not in model.listed)
            assert math.isclose(whole, got[d], rel_tol=1e-4), d


def test_model_gradients(spark):
    shape = language_model.Shape(classes=2, middle=2, per_class=3, buckets=4, hidden=4, reach=2)
    w = language_model.initial_weights(shape)
    row, at = language_model.padded([np.array([1, 5, 3, 0, 11, 7]), np.array([2, 2, 9])], shape)
    found = language_model.gradients(row, at, w, shape)
    for k in w:
        place = np.unravel_index(np.abs(found[k]).argmax(), w[k].shape)
        ends = []
        for step in (0.01, -0.01):
            moved = {n: v.copy() for n, v in w.items()}
            moved[k][place] += step
            ends.append(-float(language_model.log_probabilities(row, at, moved, shape).astype(float).mean()))
        assert math.isclose((ends[0] - ends[1]) / 0.02, found[k][place], rel_tol=0.02, abs_tol=1e-4), k


def test_main_text_leaves_the_rest_out(spark):
    page = (
        "<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body class='has-sidebar'><header>Site</header>"
        "<nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div>"
        "<article><h1>Fish &amp; chips</h1><p>One <b>two</b>\n three&nbsp;four.<div class='ad'>Buy!</div><p>Last &lt;one&gt;."
        "<form><input>Name</form><section id='comments'><p>Great!</p></section></article>"
        "<aside>Related</aside><footer>&copy; us</footer>"
    )
    assert main_text(page) == "Fish & chips\n\nOne two three four.\n\nLast <one>."
    plain = "<body><div id=menu><a>x</a></div><div><p>" + "Long text here. " * 20 + "</p><p>More. " + "And more text. " * 9 + "</p></div><div class=footer>f</div>"
    assert main_text(plain).startswith("Long text") and main_text(plain).endswith("more text.")
    assert main_text(None) == main_text("") == main_text("<p>") == ""
    pages = spark.createDataFrame([(1, None, None, 5), (1, "u", page, 6)], "page_id long, url string, html string, text int")
    assert sorted(r.n_chars for r in extract_main_text(pages).collect())[0] == 0
    assert extract_main_text(pages.where("false")).count() == 0


def test_main_text_keeps_links_of_the_article():
    page = (
        "<body><nav><a>Home</a></nav><article><h1><a href=x>Linked heading</a></h1><p>Some words here.</p>"
        "<p><a>Read the full report</a></p><ul><li><a>First item</a></li><li><a>Second item</a></li></ul><div class=ad><a>Buy</a></div></article>"
    )
    assert main_text(page) == "Linked heading\n\nSome words here.\n\nRead the full report\n\nFirst item\n\nSecond item"
    plain = f"<div id=menu><a>x</a></div><p>{'Long text. ' * 20}</p><p><a>A link between</a></p><p>{'More text. ' * 20}</p>"
    assert "A link between" in main_text(plain) and "x" not in main_text(plain).split()


def test_main_text_without_article_elements():
    short = ["".join(f"{w} " * 14).strip() + "." for w in ("first", "second", "third")]
    long = "a long part of it " * 110 + "."
    paragraphs = "".join(f"<p>{s}</p>" for s in short)
    links = "<p><a>one</a></p><p><a>two</a></p><p><a>three</a></p><p><a>four</a></p>"
    for page in (f"<body>{paragraphs}<p>{long}</p>", f"<body><p>{long}</p>{links}{paragraphs}"):
        assert all(s in main_text(page) for s in [*short, long])
    text = "Plain words of a paragraph that is read."
    for opening in ('p title="the hidden door"', 'p data-id="ad"', "div class='content-with-sidebar'", 'div class="layout-sidebar-right"'):
        assert main_text(f"<body><{opening}>{text}") == text, opening
    for opening in ("p hidden", "p id=ad", 'div class="sidebar right"', "p style='display: none'", 'p aria-hidden="true"'):
        assert main_text(f"<body><{opening}>{text}") == "", opening


def test_pipeline_stages(odd, none):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    spark, folder = odd.sparkSession, "/root/testdata/sf0.001"
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:1] + corpus_pipeline.STAGES[2:4]:
            assert stage(spark, docs, folder).columns == docs.columns, name


def test_items_with_commas_and_empty_ids_count_once_each(spark):
    docs = spark.createDataFrame([(1, PROSE)], "doc_id long, text string")
    items = spark.createDataFrame([("1", PROSE), ("a,b", PROSE), ("", PROSE)], "item_id string, text string")
    assert benchmark_hits(docs, items).first().n_items == 3


def test_near_dedup_keeps_unique_texts_that_share_an_id(spark):
    def said(n):
        return " ".join(f"t{n}w{i}" for i in range(40))

    rows = [(1, said(0)), (2, said(0)), (2, said(1)), (3, said(2)), (3, said(3)), (None, said(4)), (4, said(4)), (5, None), (6, ""), (7, said(5)), (7, said(5))]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    expected = [(1, said(0)), (2, said(1)), (3, said(2)), (3, said(3)), (4, said(4)), (5, None), (6, ""), (7, said(5))]
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(expected, key=str)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_chat_events_repeated_or_without_number(spark):
    rows = [(1, None, "message", 1, "user", "first"), (1, 2, "message", 2, "assistant", "hi"), (1, 2, "message", 2, "assistant", "hi"),
            (1, 3, "delta", 2, "assistant", " you"), (1, 3, "delta", 2, "assistant", " you"), (1, 4, "regenerate", 2, "assistant", None),
            (1, 5, "delta", 2, "assistant", "hello")]
    events = spark.createDataFrame(rows, "conv_id long, seq long, kind string, message_id long, role string, text string")
    row = chat_format.fold_events(events).first()
    assert [(t.role, t.text) for t in row.turns] == [("user", "first"), ("assistant", "hello")]
    before = chat_format.fold_events(events.where("seq is null or seq <= 3")).first()
    assert [(t.role, t.text) for t in before.turns] == [("user", "first"), ("assistant", "hi you")]
