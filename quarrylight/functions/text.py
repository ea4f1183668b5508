"""Text expressions: tokens, normalised words, overlaps, record IDs. Columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.config import SNIPPET_CHARS
from quarrylight.schemas import RECORD_ID, RECORD_PREFIXES

# Words the tokenizer drops.
STOP_WORDS = [
    "the", "a", "an", "of", "for", "to", "in", "on", "and",
    "or", "is", "are", "which", "what", "who", "by", "with",
]
# English function words, ignored on top of STOP_WORDS by content_overlap.
FUNCTION_WORDS = [
    "about", "after", "all", "am", "any", "as", "at", "be", "been", "before", "being", "both",
    "but", "can", "could", "did", "do", "does", "each", "every", "from", "had", "has", "have",
    "he", "her", "here", "his", "how", "i", "if", "into", "it", "its", "just", "me", "my",
    "no", "not", "our", "ours", "out", "over", "own", "per", "she", "so", "some", "such",
    "than", "that", "their", "them", "then", "there", "these", "they", "this", "those",
    "through", "too", "until", "up", "us", "very", "was", "we", "were", "when", "where",
    "whether", "while", "why", "will", "would", "yet", "you", "your",
]

UNVERIFIED = "[unverified]"


def words_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokenize(text: Column) -> Column:
    """Lower-case tokens in order, repeats kept.

    A token is a run of letters, digits, "_", "%" and "-" without "_" and "-" at its ends.
    Compounds stay whole and are followed by their parts; stop words are dropped; no stemming.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_%-]+)"), F.lit(1))
    trimmed = F.transform(runs, lambda run: F.btrim(run, F.lit("_-")))
    none = F.array().cast("array<string>")

    def unless_stop(token: Column) -> Column:
        return F.when((token == "") | token.isin(STOP_WORDS), none).otherwise(F.array(token))

    def expand_compound(token: Column) -> Column:
        parts = F.filter(F.split(token, "[_%-]+"), lambda part: part != "")
        whole = F.when((token != "%") & (F.size(parts) == 0), none).otherwise(unless_stop(token))
        split_up = (F.size(parts) > 1) | ((F.size(parts) == 1) & (parts[0] != token))
        inside = F.filter(parts, lambda part: ~part.isin(STOP_WORDS))
        return F.when(split_up, F.concat(whole, inside)).otherwise(whole)

    def expand(token: Column) -> Column:
        return F.when(token.rlike("[_%-]"), expand_compound(token)).otherwise(unless_stop(token))

    return F.flatten(F.transform(trimmed, expand))


def word_counts(words: Column) -> Column:
    """ARRAY<STRUCT<token, tf>>: the distinct words of an array and how often each comes, within the row.

    The words are sorted; a word's count is the distance to the start of the next run.
    """

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        # One-element arrays bind what is used for every word once per row.
        return F.transform(
            F.array(starts),
            lambda found: F.transform(
                found,
                lambda at, j: F.struct(
                    F.get(ordered, at).alias("token"),
                    (F.coalesce(F.get(found, j + 1), F.size(ordered)) - at).alias("tf"),
                ),
            ),
        )[0]

    none = F.array().cast("array<struct<token:string,tf:int>>")
    return F.transform(
        F.array(F.sort_array(words)), lambda ordered: F.when(F.size(ordered) > 0, runs(ordered)).otherwise(none)
    )[0]


def ascii_words(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def normalize_padded(text: Column) -> Column:
    """Words joined by single blanks with a blank at both ends, for whole-word matches."""
    return F.concat(F.lit(" "), F.array_join(ascii_words(text), " "), F.lit(" "))


def word_set(text: Column) -> Column:
    """Distinct words without stop words."""
    return F.array_except(F.array_distinct(ascii_words(text)), words_array(STOP_WORDS))


def name_overlap(query: Column, name: Column) -> Column:
    """Share of the name's words that the query has too; 0 for a name without words."""
    wanted = word_set(name)
    shared = F.size(F.array_intersect(wanted, word_set(query)))
    return F.when(F.size(wanted) > 0, shared / F.size(wanted)).otherwise(F.lit(0.0))


def content_overlap(query: Column, text: Column, frame: Column) -> Column:
    """Share of the query's own words (no frame, no function words) that the text has too."""
    function_words = words_array(FUNCTION_WORDS)
    content = F.array_except(F.array_except(word_set(query), frame), function_words)
    shared = F.size(F.array_intersect(content, F.array_except(word_set(text), function_words)))
    return F.when(F.size(content) > 0, shared / F.size(content)).otherwise(F.lit(0.0))


def template_words(template: Column) -> Column:
    """The fixed words of a template: placeholders such as {name} removed."""
    return word_set(F.regexp_replace(template, r"\{[a-z_]+\}", " "))


def jaccard(left: Column, right: Column) -> Column:
    """Jaccard similarity of two word sets given as arrays; 0 when both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(F.lit(0.0))


def sentence_count(text: Column) -> Column:
    """Sentences, split behind ".", "!" or "?" followed by white space."""
    return F.size(F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != ""))


def record_ids(text: Column) -> Column:
    """Every record ID in the text, in order, repeats kept."""
    return F.regexp_extract_all(text, F.lit(f"({RECORD_ID})"), F.lit(1))


def record_type(record_id: Column) -> Column:
    """employee, report, table, metric or request by the shape of the ID, else NULL."""
    kind = F.lit(None).cast("string")
    for name, prefix in RECORD_PREFIXES.items():
        kind = F.when(record_id.rlike(f"^{prefix}-[0-9]{{3,}}$"), name).otherwise(kind)
    return kind


def redact(text: Column, ids: Column) -> Column:
    """The text with each of the given IDs replaced, whole IDs only."""
    return F.aggregate(
        ids,
        text,
        lambda done, one: F.regexp_replace(
            done, F.concat(F.lit(r"\b"), one, F.lit(r"\b")), F.lit(UNVERIFIED)
        ),
    )


def is_distinctive(alias: Column) -> Column:
    """An acronym (two or more of A-Z, 0-9, %, &) or at least two words."""
    return alias.rlike("^[A-Z0-9%&]{2,}$") | (F.size(ascii_words(alias)) >= 2)


def snippet(text: Column) -> Column:
    """At most 160 characters, the last three of them dots when something was cut."""
    return F.when(
        F.length(text) > SNIPPET_CHARS,
        F.concat(F.substring(text, 1, SNIPPET_CHARS - 3), F.lit("...")),
    ).otherwise(text)


def shorten(text: Column, limit: int = 70) -> Column:
    """At most `limit` characters, the last one an ellipsis when something was cut."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))
    ).otherwise(text)


def weighted_text(*parts: tuple[Column, int]) -> Column:
    """Fields repeated by weight and joined by blanks, empty ones left out."""
    repeated = [F.nullif(part, F.lit("")) for part, times in parts for _ in range(times)]
    return F.concat_ws(" ", *repeated)


def sentences(*parts: Column) -> Column:
    """Each non-blank part trimmed, its trailing dots replaced by one, joined by blanks."""
    closed = []
    for part in parts:
        text = F.trim(part)
        closed.append(
            F.when(text != "", F.concat(F.regexp_replace(text, r"\.+$", ""), F.lit(".")))
        )
    return F.concat_ws(" ", *closed)
