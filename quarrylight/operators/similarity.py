"""Look-alike names: an exact Jaccard self-join over token prefixes, no pairwise comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import ascii_words, jaccard

NAME_LIMIT = 0.6


def distinct_names(names: DataFrame) -> DataFrame:
    """names(id, name) -> one row per set of words: words, key, copies, first_id."""
    words = F.array_sort(F.array_distinct(ascii_words(F.col("name"))))
    return (
        names.select("id", words.alias("words")).where(F.size("words") > 0)
        .groupBy("words")
        .agg(F.count("*").alias("copies"), F.min("id").alias("first_id"))
        .withColumn("key", F.array_join("words", " "))
    )


def similar_name_pairs(names: DataFrame, limit: float = NAME_LIMIT) -> DataFrame:
    """Pairs of different word sets with Jaccard above the limit, each pair once.

    (key_a, key_b, similarity, copies_a, copies_b, first_a, first_b). Equal sets are one row
    beforehand (copies says how many IDs share it), so a thousand equal names are no pairs.
    Words are ordered from rare to frequent. Sets of m and n words above the limit share at least
    o = floor(limit / (1 + limit) * (m + n)) + 1 words, so they share one among the first
    m - o + 1 of the one and the first n - o + 1 of the other. The larger set offers the prefix
    that serves every smaller partner, the smaller one the shorter prefix that serves every
    larger partner, and the join keeps only words early enough in both. Frequent words stay out
    of the prefixes of all sets that have enough rarer ones.
    """
    sets = distinct_names(names).select("key", "words", "copies", "first_id")
    spread = sets.select("key", F.size("words").alias("n"), F.explode("words").alias("word"))
    frequency = spread.groupBy("word").agg(F.count("*").alias("df"))
    ordered = (
        spread.join(frequency, "word")
        .groupBy("key", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("ranked"))
    )
    placed = ordered.select("key", "n", F.posexplode("ranked").alias("pos", "r")).select(
        "key", "n", "pos", F.col("r.word").alias("word")
    )
    shared = limit / (1 + limit)
    larger = placed.where(F.col("pos") < F.col("n") - F.floor(F.lit(limit) * F.col("n"))).alias("a")
    smaller = placed.where(
        F.col("pos") < F.col("n") - F.floor(F.lit(2 * shared) * F.col("n"))
    ).alias("b")
    overlap = F.floor(F.lit(shared) * (F.col("a.n") + F.col("b.n"))) + 1
    in_order = (F.col("b.n") < F.col("a.n")) | (
        (F.col("b.n") == F.col("a.n")) & (F.col("b.key") < F.col("a.key"))
    )
    early = (F.col("a.pos") <= F.col("a.n") - overlap) & (F.col("b.pos") <= F.col("b.n") - overlap)
    candidates = larger.join(smaller, (F.col("a.word") == F.col("b.word")) & in_order & early).select(
        F.least("a.key", "b.key").alias("key_a"), F.greatest("a.key", "b.key").alias("key_b")
    ).distinct()

    def side(name: str) -> DataFrame:
        return sets.select(
            F.col("key").alias(f"key_{name}"), F.col("words").alias(f"words_{name}"),
            F.col("copies").alias(f"copies_{name}"), F.col("first_id").alias(f"first_{name}"),
        )

    return (
        candidates.join(side("a"), "key_a").join(side("b"), "key_b")
        .withColumn("similarity", jaccard(F.col("words_a"), F.col("words_b")))
        .where(F.col("similarity") > limit)
        .select("key_a", "key_b", "similarity", "copies_a", "copies_b", "first_a", "first_b")
    )


def lookalikes(names: DataFrame, designed: DataFrame, limit: float = NAME_LIMIT) -> DataFrame:
    """similar_name_pairs and repeated names, without the designed pairs(a, b) of IDs.

    A pair of word sets is reported through its lowest IDs; a repeated set through its first
    and last ID.
    """
    pairs = similar_name_pairs(names, limit).select(
        F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"),
        "similarity",
    )
    words = F.array_sort(F.array_distinct(ascii_words(F.col("name"))))
    repeated = (
        names.groupBy(words.alias("words")).agg(F.min("id").alias("a"), F.max("id").alias("b"))
        .where("a < b AND size(words) > 0")
        .select("a", "b", F.lit(1.0).alias("similarity"))
    )
    skip = designed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.union(repeated).join(skip, ["a", "b"], "left_anti")
