"""Line-first quality cleaning, in DataFrame functions only.

Every line is judged by itself: shouting, symbols, navigation (a chain of separated entries) and
boilerplate (notices that sites repeat). Punctuation is judged on runs of lines up to a blank line, a
line that ends a sentence or one too long for wrapped text: a sentence ends in the run, or the run is a list or a
heading above text. Failing lines go; a document that loses more than `max_lost` of its characters, or
fails the base rules, is rejected.

Base rules: fewer than 50 words, or more than half of the words in three-word windows that the text
repeats. Nothing is shuffled and no row is split, so a document's whole text is judged in one task.

Nulls: a null text is the empty text, which has no words and fails the base rules; a null id stays null.
Empty tables give empty results; repeated rows are judged each. Columns named `_...` are not needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.tables import computed, text_of

MIN_WORDS = 50
MAX_LOST = 0.3
# Notices that sites repeat on their pages. Fixed values.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service",
    "privacy policy", "cookie policy", "we use cookies", "accept cookies", "enable javascript",
    "javascript is disabled", "lorem ipsum", "click here", "read more", "sign up for", "subscribe to our",
    "share this", "skip to content", "powered by", "obtain a copy of the license",
)
NOTICE = r"(?<![\p{L}\p{N}])(?:" + "|".join(BOILERPLATE) + r")(?![\p{L}\p{N}])"
NOTICE_CHARS = 100
SYMBOLS = "#*$%&|<>"
BARS = "|»›•·→"
BLANKS = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
# Ends of sentences in the scripts that mark them, with closing quotes or brackets. Fixed values.
ENDS = ".!?…。！？｡．।॥؟۔։።፧፨။។៕༎།‼⁇⁈⁉᠃᙮꘎꘏߹꓿"
CLOSERS = r"[\"'”’»)\]」』]"
SENTENCE_END = rf"[{ENDS}]{CLOSERS}*(?:[\x20\x09-\x0D]|$)"
# Lines of wrapped text have so many characters at most; longer ones are runs of their own.
WRAP_CHARS = 120
# Where a run of lines ends: at blank lines, behind a line that ends a sentence or ends in a bar, and around
# long lines. A run below a blank line keeps a line break in front.
RUN_END = (
    rf"\n(?:(?=[\x20\x09-\x0D]*\n)|(?<=[|»›•·→][\x20\x09]{{0,4}}\n)|(?<=[{ENDS}]{CLOSERS}{{0,4}}[\x20\x09\x0B-\x0D]{{0,4}}\n)"
    rf"|(?<=[^\n]{{{WRAP_CHARS + 1}}}\n)|(?=[^\n]{{{WRAP_CHARS + 1}}}))"
)
# A lone word right behind a finished line, with no blank line between, is neither heading nor wrapped text.
LONE = rf"^[^\s:：{ENDS}\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}\p{{IsThai}}]{{1,30}}[\x20\x09]*(?:\n|$)"
# The first or second line of a list begins with a mark; or a line announces what follows.
LIST = r"^\n?(?:[^\n]*\n)?[\x20\x09]*(?:[-*+•‣◦–]|\(?(?:[0-9]{1,3}|[A-Za-z])[.)])[\x20\x09]+[^\x20\x09-\x0D]"
ANNOUNCES = r"[:：][\x20\x09\x0B-\x0D]*(?:\n|$)"
HEADING_CHARS = 100


def without(column: Column, characters: str) -> Column:
    return F.translate(column, characters, "")


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, SPLIT), lambda w: w != "")


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def count_of(column: Column, characters: str) -> Column:
    """How often any of the characters occurs."""
    return F.size(F.split(column, f"[{characters}]")) - 1


def shouting(line: Column) -> Column:
    """Nearly all of its letters are capitals, with shouted ends."""
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace(line, r"[^\p{Lu}]", ""))
    shouts = (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    return line.contains("!!") & (shouts >= 3) & (letters >= 20) & (capitals > 0.6 * letters)


def marked_run(run: Column) -> Column:
    """A run of lines with whether it stands by itself: a sentence ends in it, or it is or announces a list."""
    stands = run.rlike(SENTENCE_END) | run.rlike(LIST) | run.rlike(ANNOUNCES)
    return F.struct(run.alias("run"), stands.alias("stands"))


def lone(run: Column, i: Column) -> Column:
    return (i > 0) & run.rlike(LONE)


def punctuated(marked: Column, i: Column) -> Column:
    """Whether the i-th run stands, follows an announcement, or is a heading: one short line with a run
    that stands among the next two."""

    def stands(k: Column) -> Column:
        return F.coalesce(F.get(marked, k)["stands"], F.lit(False))

    run = F.get(marked, i)["run"]
    heading = (F.length(run) <= HEADING_CHARS) & ~F.regexp_replace(run, r"^\n", "").contains("\n") & ~lone(run, i)
    announced = F.coalesce(F.get(marked, i - 1)["run"].rlike(ANNOUNCES.replace(r"\n|", "")), F.lit(False))
    return stands(i) | (heading & (stands(i + 1) | stands(i + 2))) | announced


def bad_symbols(line: Column) -> Column:
    return line.rlike(f"[{SYMBOLS}]") & (count_of(line, SYMBOLS) * 20 > F.length(without(line, BLANKS)))


def navigation(line: Column) -> Column:
    """Entries between bars, arrows or bullets."""
    marks, spaces = count_of(line, BARS), F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return line.rlike(f"[{BARS}]") & (marks >= 3) & (marks * 6 > spaces)


def boilerplate(line: Column, run: Column) -> Column:
    """A notice that is the line: in a short run, or most of a line that does not go on in small letters."""
    low = F.lower(line)
    without_notices = F.regexp_replace(low, NOTICE, "")
    most = (F.length(without_notices) * 2 <= F.length(line)) & ~line.rlike(r"^[\x20\x09]*\p{Ll}")
    return low.rlike(NOTICE) & ((F.length(run) <= NOTICE_CHARS) | most)


def line_passes(line: Column, run: Column) -> Column:
    return ~(bad_symbols(line) | navigation(line) | boilerplate(line, run) | shouting(line))


def good_lines(marked: Column) -> Column:
    """The lines that pass, of all runs in order."""

    def of(m: Column, i: Column) -> Column:
        lines = F.filter(F.split(m["run"], "\n"), lambda line, k: has_word(line) & ((k > 0) | ~lone(m["run"], i)))
        return F.when(punctuated(marked, i), F.filter(lines, lambda line: line_passes(line, m["run"]))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(marked, of))


def repeated_positions(sorted_windows: Column) -> Column:
    """Start positions, ascending, of windows whose hash a neighbour in sorted order shares."""
    same = F.filter(
        sorted_windows,
        lambda x, i: (x["h"] == F.get(sorted_windows, i - 1)["h"]) | (x["h"] == F.get(sorted_windows, i + 1)["h"]),
    )
    return F.array_sort(F.transform(same, lambda x: x["i"]))


def covered(starts: Column, width: int) -> Column:
    """Words that windows of `width` words from these ascending starts cover together."""
    own = F.transform(starts, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(starts, i + 1), x + width) - x))
    return F.aggregate(own, F.lit(0), lambda a, x: a + x)


def quality_rules(docs: DataFrame, text_column: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """All columns of `docs` in a struct `row`, then n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, n_lines (with a word), n_failed_lines, cleaned (the text without failing
    lines), kept."""
    text = F.col("_text")
    lines = F.split(text, "\n")
    step = docs.select(F.struct("*").alias("row"), text_of(text_column).alias("_text"))
    step = step.select("row", "_text", word_array(text).alias("_words"), F.filter(lines, has_word).alias("_lines"))
    step = step.withColumn("_n", F.size("_words"))
    words = F.col("_words")
    hashes = F.transform(
        F.slice(words, 1, F.greatest(F.col("_n") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    step = step.withColumn("_hashes", hashes)
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    pairs = F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    step = step.withColumn("_sorted", F.when(repeats, F.array_sort(pairs)))
    step = step.withColumn("_starts", F.when(F.col("_sorted").isNotNull(), repeated_positions(F.col("_sorted"))))
    step = step.withColumn("_marked", F.transform(F.filter(F.split(text, RUN_END), has_word), marked_run))
    # A lambda's variable is worked out once; the column itself would be for each run.
    step = step.withColumn("_good", F.get(F.transform(F.array("_marked"), good_lines), 0))
    cleaned = F.when(
        F.size("_good") == F.size("_lines"), text
    ).otherwise(F.array_join("_good", "\n"))
    flat = computed(
        step,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered(F.col("_starts"), 3), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_good")).cast("long").alias("n_failed_lines"),
        F.length(F.array_join("_lines", "")).alias("_all"),
        F.length(F.array_join("_good", "")).alias("_left"),
        cleaned.alias("cleaned"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    enough = F.col("_left") >= (1 - max_lost) * F.col("_all")
    return flat.withColumn("base_failed", failed).select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_lines", "n_failed_lines", "cleaned", (~F.col("base_failed") & enough).alias("kept"),
    )
