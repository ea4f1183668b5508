"""Other scalar expressions: packed fields, declared types, dates, costs, secrets, links, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Credential shapes, by kind.
SECRET_PATTERNS = {
    "sk- style API key": r"(?<![A-Za-z0-9])sk-[A-Za-z0-9_\-]{20,}",
    "Hugging Face token": r"(?<![A-Za-z0-9])hf_[A-Za-z0-9]{30,}",
    "GitHub token": r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,})",
    "AWS access key id": r"\bAKIA[0-9A-Z]{16}\b",
    "Google API key": r"\bAIza[0-9A-Za-z_\-]{35}\b",
    "private key block": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "*_KEY assignment": r"[A-Z0-9_]*_KEY\s*[=:]\s*[\"']?[A-Za-z0-9+/_\-]{30,}",
}

QUOTA_ZONE = "America/Los_Angeles"
COLUMN_LIST = "array<struct<name:string,type:string>>"


def packed_list(column: Column) -> Column:
    """a|b|c as an array; no entries for an empty cell."""
    return F.filter(F.split(column, r"\|"), lambda part: part != "")


def json_ids(column: Column) -> Column:
    """A JSON list of strings as an array."""
    return F.from_json(column, "array<string>")


def json_columns(column: Column) -> Column:
    """A JSON list of {name, type} as an array of structs."""
    return F.from_json(column, COLUMN_LIST)


def declared_type(name: Column) -> Column:
    """The warehouse type a column name implies; the first matching rule decides."""
    ends = lambda *suffixes: name.rlike("(" + "|".join(suffixes) + ")$")
    return (
        F.when(name.rlike("^(is_|has_)") | ends("_flag"), "boolean")
        .when(ends("_key"), "integer")
        .when(ends("_id", "_code") | name.isin("vin", "part_number"), "string")
        .when(ends("_date"), "date")
        .when(ends("_at"), "timestamp")
        .when(name.contains("hours"), "decimal(9,2)")
        .when(name.rlike("amount|price|revenue|cost|value"), "decimal(18,2)")
        .when(ends("_score"), "decimal(5,2)")
        .when(
            ends(
                "_qty", "_count", "_days", "_minutes", "_year", "_quarter", "_month", "_week",
                "_level", "units", "_since_purchase",
            )
            | name.startswith("days_"),
            "integer",
        )
        .otherwise("string")
    )


def quota_day(instant: Column) -> Column:
    """The provider's day of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(instant, QUOTA_ZONE))


def clamp_date(day: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(day, low), high)


def cost_usd(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Token cost at prices per million tokens."""
    return (tokens_in * F.lit(price_in) + tokens_out * F.lit(price_out)) / F.lit(1_000_000.0)


def secret_kinds(text: Column) -> Column:
    """The kinds of credentials a text holds, never the credential."""
    found = [F.when(text.rlike(pattern), F.lit(kind)) for kind, pattern in SECRET_PATTERNS.items()]
    return F.array_compact(F.array(*found))


def markdown_links(text: Column) -> Column:
    """Targets of [label](target) links, in order."""
    return F.regexp_extract_all(text, F.lit(r"!?\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))


def link_kind(target: Column) -> Column:
    """external (http), ignored (anchors and mail) or local."""
    return (
        F.when(target.rlike("^https?://"), "external")
        .when(target.startswith("#") | target.startswith("mailto:"), "ignored")
        .otherwise("local")
    )


def content_key(*parts: Column) -> Column:
    """sha256 of the parts, each prefixed with its length so that they cannot run together."""
    pieces = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.sha2(F.concat_ws("|", *pieces), 256)


ANSWER = "answer STRING, answer_ids ARRAY<STRING>, evidence_ids ARRAY<STRING>, abstained BOOLEAN"


def _answer_object(body: Column) -> Column:
    """The four typed fields of a JSON object, NULL when the text is not exactly that."""
    parsed = F.from_json(body, ANSWER, {"mode": "PERMISSIVE"})
    keys = F.array_sort(F.json_object_keys(body))
    wanted = F.array(*[F.lit(k) for k in ("abstained", "answer", "answer_ids", "evidence_ids")])
    typed = (
        F.get_json_object(body, "$.abstained").isin("true", "false")
        & parsed["answer"].isNotNull()
        & parsed["answer_ids"].isNotNull()
        & parsed["evidence_ids"].isNotNull()
        & parsed["abstained"].isNotNull()
    )
    return F.when((keys == wanted) & typed, parsed)


def parse_final_answer(text: Column) -> Column:
    """The answer object in a model's last message: bare, in a code fence, or inside prose.

    ID lists are trimmed, blanks and repeats dropped, order kept.
    """
    body = F.trim(text)
    fenced = F.regexp_extract(body, r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
    body = F.when(fenced != "", fenced).otherwise(body)
    inner = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    parsed = F.coalesce(_answer_object(body), _answer_object(inner))

    def tidy(ids: Column) -> Column:
        return F.array_distinct(F.filter(F.transform(ids, lambda i: F.trim(i)), lambda i: i != ""))

    return F.when(
        parsed.isNotNull(),
        F.struct(
            parsed["answer"].alias("answer"), tidy(parsed["answer_ids"]).alias("answer_ids"),
            tidy(parsed["evidence_ids"]).alias("evidence_ids"),
            parsed["abstained"].alias("abstained"),
        ),
    )
