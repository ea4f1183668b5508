"""Personal data in texts, in DataFrame functions only.

Regular expressions propose spans. Checksums and ranges confirm them: Luhn for card numbers, mod-97 for
bank account numbers (IBAN), number ranges for addresses and phones. Words next to a span raise or lower
its score; kinds that a checksum cannot confirm count only with such a word beside them.

A span's place comes from the text's pieces between matches: the same expression cuts the text and lists
its matches, and lengths are added up in code points. Every expression keeps to possessive or fixed
repeats, so long runs of one character cost linear time and no deep stack.

Nulls: a null text is empty and has no spans; a null id stays null. Empty tables give empty results;
repeated rows are judged each; other columns are kept in the struct `row`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.tables import computed, text_of

CONTEXT_CHARS = 48
LEAST_SCORE = 0.5


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def characters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def weight(c: Column, i: Column) -> Column:
        doubled = c.cast("int") * 2
        return F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    total = F.aggregate(F.transform(characters(F.reverse(digits)), weight), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Whether letters and digits, four first moved to the end, leave 1 when divided by 97."""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))

    def fold(rest: Column, c: Column) -> Column:
        number = F.ascii(c) - 48
        return F.when(number < 10, (rest * 10 + number) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(characters(moved), F.lit(0), fold) == 1


def small_parts(address: Column) -> Column:
    """Whether all numbers between dots are at most 255, leading zeros aside."""

    def small(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+", "")
        return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))

    return F.forall(F.split(address, r"\."), small)


def _email(_: Column) -> Column:
    return F.lit(True)


def _card(value: Column) -> Column:
    return luhn(digits_of(value))


def _phone(value: Column) -> Column:
    return F.length(digits_of(value)).between(9, 15)


# Characters of an account number by country, as registered. Fixed values.
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "HR LV LI CH",
    22: "BH BG CR GE DE IE ME RS GB VA", 23: "GI IQ IL TL AE OM SO", 24: "AD CZ MD PK RO SA SK ES SE TN VG DZ",
    25: "PT ST LY", 26: "IS TR", 27: "FR GR IT MR MC SM BI DJ", 28: "AL AZ BY CY DO GT HU LB PL SV NI", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def account_pattern() -> str:
    """A country's letters, then as many characters as its numbers have, in groups or not; letters or
    digits right behind are no part of another number. Other countries: 11 to 30 characters behind."""
    known = [
        rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{length - 4}}}(?![A-Za-z0-9])"
        for length, countries in ACCOUNT_LENGTHS.items()
    ]
    listed = "|".join(" ".join(ACCOUNT_LENGTHS.values()).split())
    other = rf"(?!{listed})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}(?![A-Za-z0-9])"
    return rf"(?<![A-Za-z0-9])(?:{'|'.join(known)}|{other})"


def _account(value: Column) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    return F.length(plain).between(15, 34) & mod97(plain)


@dataclass(frozen=True)
class Kind:
    """A kind of span: what proposes it, what confirms it, and how words beside it move its score."""

    name: str
    pattern: str
    hint: str  # characters that every match holds one of; texts without them are not searched
    confirm: object
    score: float
    words: str
    base: bool


# The first four are the base kinds, in the order in which results list them. Matches are leftmost and
# do not overlap; a match may begin where the one before ended or where no character of its run precedes.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         "@", _email, 0.9, r"mail|contact|write", True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", small_parts, 0.6, r"\bip\b|host|server|address", True),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])", "0123456789", _card, 0.8,
         r"card|visa|credit|pay", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", _phone, 0.7, r"phone|tel|call|mobile|fax", True),
    Kind("iban", account_pattern(), "0123456789", _account, 0.9,
         r"iban|account|bank", False),
    Kind("local_phone", r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])", "0123456789", _email, 0.3,
         r"phone|\btel\b|call|mobile|fax", False),
    Kind("social_number", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "0123456789", _email, 0.3,
         r"\bssn\b|social security", False),
)
CONTEXT_GAIN = 0.3
# Words that speak against a span: numbers of things, not of people.
AGAINST = r"\b(?:order|invoice|version|isbn|serial|build)\b"
AGAINST_LOSS = 0.2


def proposed(text: Column, kind: Kind) -> tuple[Column, Column]:
    """(matches, pieces between them); both null where the text has none of the hint characters."""
    hinted = F.length(F.translate(text, kind.hint, "")) < F.length(text)
    return (
        F.when(hinted, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))),
        F.split(text, kind.pattern, -1),
    )


def placed(matches: Column, pieces: Column) -> Column:
    """Matches as structs (start, end, text), by adding up the lengths of pieces and matches."""
    shape = "array<struct<start:int,end:int,text:string>>"

    def add(so_far: Column, i: Column) -> Column:
        match = F.get(matches, i)
        start = so_far["at"] + F.length(F.get(pieces, i))
        span = F.struct(start.alias("start"), (start + F.length(match)).alias("end"), match.alias("text"))
        return F.struct(span["end"].alias("at"), F.concat(so_far["spans"], F.array(span)).cast(shape).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(shape).alias("spans"))
    return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), start, add)["spans"]


def find_private_data(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """All columns of `docs` in a struct `row`, the whole `text`, and `spans`: an array of (kind_no, kind,
    start, end, text, score), by kind and then start. Base kinds that pass their check always stay."""
    step = docs.select(F.struct("*").alias("row"), text_of(text_column).alias("_text"))
    text = F.col("_text")
    step = step.select("row", "_text", *(proposed(text, k)[0].alias(f"_m_{k.name}") for k in KINDS))
    step = step.select(
        "row", "_text", *(f"_m_{k.name}" for k in KINDS),
        *(F.when(F.size(f"_m_{k.name}") > 0, proposed(text, k)[1]).alias(f"_p_{k.name}") for k in KINDS),
    )
    step = step.select(
        "row", "_text",
        *(
            F.when(F.col(f"_p_{k.name}").isNotNull(), placed(F.col(f"_m_{k.name}"), F.col(f"_p_{k.name}"))).alias(f"_s_{k.name}")
            for k in KINDS
        ),
    )

    def judged(number: int, kind: Kind) -> Column:
        def score(span: Column) -> Column:
            before = F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0))
            around = F.lower(F.substring(text, before + 1, span["start"] - before))
            after = F.lower(F.substring(text, span["end"] + 1, F.lit(CONTEXT_CHARS)))
            near = around.rlike(kind.words) | after.rlike(kind.words)
            against = around.rlike(AGAINST)
            total = F.lit(kind.score) + F.when(near, CONTEXT_GAIN).otherwise(0.0) - F.when(against, AGAINST_LOSS).otherwise(0.0)
            return F.round(F.least(F.lit(1.0), total), 3)

        confirmed = F.filter(F.col(f"_s_{kind.name}"), lambda s: kind.confirm(s["text"]))
        scored = F.transform(
            confirmed,
            lambda s: F.struct(
                F.lit(number).alias("kind_no"), F.lit(kind.name).alias("kind"), s["start"].alias("start"),
                s["end"].alias("end"), s["text"].alias("text"), score(s).alias("score"),
            ),
        )
        kept = scored if kind.base else F.filter(scored, lambda s: s["score"] >= LEAST_SCORE)
        shape = "array<struct<kind_no:int,kind:string,start:int,end:int,text:string,score:double>>"
        return F.when(F.col(f"_s_{kind.name}").isNull(), F.array().cast(shape)).otherwise(kept.cast(shape))

    spans = F.concat(*(judged(n, k) for n, k in enumerate(KINDS)))
    return computed(step, F.col("_text").alias("text"), spans.alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined in their order."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def masked(found: DataFrame) -> DataFrame:
    """The result of find_private_data with `masked`: each span replaced by its kind in brackets;
    a span that overlaps one before it is dropped from the masking, not from `spans`."""
    shape = "struct<at:int,text:string>"

    def add(so_far: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), so_far["at"] + 1, s["start"] - so_far["at"])
        grown = F.struct(s["end"].alias("at"), F.concat(so_far["text"], gap, F.lit("["), s["kind"], F.lit("]")).alias("text"))
        return F.when(s["start"] >= so_far["at"], grown).otherwise(so_far).cast(shape)

    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text")).cast(shape)
    body = F.aggregate(by_place, start, add)
    rest = F.length("text")
    return found.withColumn("_body", body).select(
        "*", F.concat(F.col("_body.text"), F.substring(F.col("text"), F.col("_body.at") + 1, rest)).alias("masked")
    ).drop("_body")
