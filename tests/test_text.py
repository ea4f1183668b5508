import pytest
from pyspark.sql import functions as F

from quarrylight.functions import scalars, text

TOKENS = [
    ("dim_customer", ["dim_customer", "dim", "customer"]),
    ("RPT-0142", ["rpt-0142", "rpt", "0142"]),
    ("GM%", ["gm%", "gm"]),
    ("Gross Margin %", ["gross", "margin", "%"]),
    ("port-to-dealer transit", ["port-to-dealer", "port", "dealer", "transit"]),
    ("P&L - Monthly (Extended)", ["p", "l", "monthly", "extended"]),
    ("the of and", []),
    ("sales sales", ["sales", "sales"]),
    ("-- __ %%", []),
    ("Ünïcode Größe", ["ünïcode", "größe"]),
    ("", []),
]


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("value", "expected"), TOKENS)
def test_tokenize(spark, value, expected):
    assert one(spark, value, text.tokenize) == expected


def test_words_and_overlaps(spark):
    assert one(spark, "A  Big-Cat!", text.normalize_padded) == " a big cat "
    assert sorted(one(spark, "the cat and the dog cat", text.word_set)) == ["cat", "dog"]
    row = spark.createDataFrame([("sales by region", "Region Sales Report")], "q string, n string")
    assert row.select(text.name_overlap(F.col("q"), F.col("n")).alias("o")).first()["o"] == pytest.approx(2 / 3)
    frame = text.words_array(["sales"])
    assert row.select(text.content_overlap(F.col("q"), F.col("n"), frame).alias("o")).first()["o"] == 1.0


def test_record_ids_and_redaction(spark):
    value = "RPT-0001 and EMP-012, not XRPT-0002 or EMP-12; RPT-0001"
    assert one(spark, value, text.record_ids) == ["RPT-0001", "EMP-012", "RPT-0001"]
    redacted = one(spark, value, lambda c: text.redact(c, F.array(F.lit("RPT-0001"))))
    assert redacted == "[unverified] and EMP-012, not XRPT-0002 or EMP-12; [unverified]"
    assert one(spark, "MET-001", text.record_type) == "metric"
    assert one(spark, "MET-01", text.record_type) is None


def test_distinctive_snippet_sentences(spark):
    assert one(spark, "GM%", text.is_distinctive)
    assert one(spark, "gross margin", text.is_distinctive)
    assert not one(spark, "units", text.is_distinctive)
    assert len(one(spark, "x" * 161, text.snippet)) == 160
    assert one(spark, "x" * 160, text.snippet) == "x" * 160
    assert one(spark, "One. Two! Three?", text.sentence_count) == 3
    assert one(spark, "Ends..  ", lambda c: text.sentences(c, F.lit(" "))) == "Ends."


def test_declared_types(spark):
    cases = {
        "is_open": "boolean", "dealer_key": "integer", "vin": "string", "ship_date": "date",
        "loaded_at": "timestamp", "labour_hours": "decimal(9,2)", "unit_price": "decimal(18,2)",
        "nps_score": "decimal(5,2)", "order_qty": "integer", "days_open": "integer", "name": "string",
    }
    for name, kind in cases.items():
        assert one(spark, name, scalars.declared_type) == kind


def test_secrets_and_links(spark):
    value = "key AKIA" + "A1B2C3D4E5F6G7H8" + " and hf_" + "a" * 32 + " risk-" + "b" * 30
    assert one(spark, value, scalars.secret_kinds) == ["Hugging Face token", "AWS access key id"]
    found = one(spark, "[a](x.md) ![b](http://y) [c](#z)", scalars.markdown_links)
    assert found == ["x.md", "http://y", "#z"]


ANSWER = '{"answer": "x", "answer_ids": [" RPT-0001", "RPT-0001", ""], "evidence_ids": [], "abstained": false}'


@pytest.mark.parametrize(
    ("message", "ok"),
    [
        (ANSWER, True), (f"```json\n{ANSWER}\n```", True), (f"Here: {ANSWER} Bye", True),
        ("no json", False), ('{"answer": "x"}', False), ("", False),
        (ANSWER.replace("false", '"no"'), False),
    ],
)
def test_final_answer(spark, message, ok):
    parsed = one(spark, message, scalars.parse_final_answer)
    assert (parsed is not None) is ok
    if ok:
        assert parsed["answer_ids"] == ["RPT-0001"]
