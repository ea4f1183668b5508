import random

import pytest

from quarrylight.operators import audit


def brute(rows, terms):
    return sorted(
        (key, line, n)
        for key, text in rows if text is not None
        for line, content in enumerate(text.split("\n"), 1)
        for n, term in enumerate(terms, 1) if term.lower() in content.lower()
    )


def scanned(spark, rows, terms):
    texts = spark.createDataFrame(rows, "id long, text string")
    return sorted(map(tuple, audit.term_scan(texts, "id", "text", terms).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_term_scan_matches_brute_force(spark, seed):
    rng = random.Random(seed)

    def word(most):
        return "".join(rng.choice("abAB \n") for _ in range(rng.randrange(most)))

    rows = [(n, word(40)) for n in range(60)] + [(60, None), (61, ""), (61, "ab\nab"), (61, "ab\nab")]
    # Terms inside other terms, repeated ones, one with a line break and (once) the empty one.
    terms = ["ab", "a", "bab", "AB", "b\na", " ", "zz"] + ([""] if seed == 1 else [])
    assert scanned(spark, rows, terms) == brute(rows, terms)


def test_term_scan_without_terms_or_rows(spark):
    assert scanned(spark, [(1, "a")], []) == []
    assert scanned(spark, [], ["a"]) == []


def test_ten_thousand_terms_are_one_expression(spark, capsys):
    terms = [f"word{n}x" for n in range(10_000)]
    rows = [(n, f"see Word{n * 7}X\nand word{n}x or word{n}y") for n in range(300)]
    texts = spark.createDataFrame(rows, "id long, text string")
    found = audit.term_scan(texts, "id", "text", terms)
    found.explain()
    assert len(capsys.readouterr().out) < 3_000
    assert sorted(map(tuple, found.collect())) == sorted(
        [(n, 1, n * 7 + 1) for n in range(300)] + [(n, 2, n + 1) for n in range(300)]
    )


def test_version_scan_reports_the_first_holder(spark):
    rows = [("b", 2, "Alpha\nalpha beta"), ("a", 3, "Alpha\nalpha beta"), ("c", 1, "none"), ("d", 4, None)]
    versions = spark.createDataFrame(rows, "path string, version long, text string")
    got = sorted(map(tuple, audit.version_scan(versions, ["alpha", "beta", "gamma"]).collect()))
    assert got == [("b", 2, 2, "term 1"), ("b", 2, 2, "term 2")]
