"""Scoring answers against gold IDs, and removing IDs no tool ever returned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.config import F1_THRESHOLD
from quarrylight.functions.text import record_ids, redact

# Fixed value: what an answer whose IDs were all removed says.
UNVERIFIED_NOTE = (
    " (I could not verify the records behind this answer in the tool results, so I am not "
    "giving one.)"
)


def scoring_rule(category: Column, subtype: Column, gold_size: Column) -> Column:
    """The rule of a question; F1 on a single gold ID becomes contains_all."""
    rule = (
        F.when(category == "L6", "abstain")
        .when(category == "L4", "contains_any")
        .when(category == "L3", "set_f1")
        .when((category == "L5") & (subtype == "individual"), "set_f1")
        .when((category == "MX") & (subtype == "metric_owners"), "set_f1")
        .otherwise("contains_all")
    )
    return F.when((rule == "set_f1") & (gold_size == 1), "contains_all").otherwise(rule)


def score_columns(
    rule: Column, given: Column, gold: Column, forbidden: Column, abstained: Column
) -> dict[str, Column]:
    """correct, and the details each rule reports (NULL under the other rules)."""
    given = F.array_distinct(given)
    gold = F.array_distinct(gold)
    hits = F.size(F.array_intersect(given, gold))
    n_given, n_gold = F.size(given), F.size(gold)
    forbidden_hit = F.array_sort(F.array_intersect(given, forbidden))
    people = F.array_sort(F.filter(given, lambda i: i.startswith("EMP-")))
    zero = F.lit(0.0)
    precision = F.when(n_given > 0, hits / n_given).otherwise(zero)
    recall = F.when(n_gold > 0, hits / n_gold).otherwise(zero)
    f1 = F.when(n_given + n_gold > 0, F.lit(2) * hits / (n_given + n_gold)).otherwise(zero)
    is_all, is_any = rule == "contains_all", rule == "contains_any"
    is_f1, is_abstain = rule == "set_f1", rule == "abstain"
    all_given = F.size(F.array_except(gold, given)) == 0
    correct = (
        F.when(is_all, ~abstained & all_given & (F.size(forbidden_hit) == 0))
        .when(is_any, ~abstained & (hits > 0))
        .when(is_f1, ~abstained & (f1 >= F1_THRESHOLD))
        .when(is_abstain, abstained & (F.size(people) == 0))
    )
    return {
        "correct": correct,
        "forbidden_hit": F.when(is_all, forbidden_hit),
        "hits": F.when(is_any, hits),
        "precision": F.when(is_f1, precision),
        "recall": F.when(is_f1, recall),
        "f1": F.when(is_f1, f1),
        "people_given": F.when(is_abstain, people),
    }


GOLD = ["gold_ids", "forbidden_ids", "should_abstain", "scoring", "gold_type", "node_id", "depth"]


def with_gold(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Lines joined to the gold of their question; lines without a question drop out."""
    return lines.join(items.select("item_id", *GOLD), "item_id")


def score_answers(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Lines with a fresh score by the rule of their question."""
    joined = with_gold(lines, items)
    scores = score_columns(
        F.col("scoring"), F.col("answer_ids"), F.col("gold_ids"), F.col("forbidden_ids"),
        F.col("abstained"),
    )
    return joined.withColumns(scores).drop(*GOLD)


def ground_answers(answers: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Answers without the IDs their conversation never saw.

    answers(keys, answer, answer_ids, evidence_ids, abstained); seen(keys, record_id) in long
    form. The IDs an answer mentions (few) are exploded and checked by an anti join; the seen
    IDs of a conversation (many) are never gathered. An answer left without IDs abstains.
    """
    mentioned = answers.withColumn(
        "mentioned",
        F.array_distinct(F.concat("answer_ids", "evidence_ids", record_ids(F.col("answer")))),
    )
    unseen = (
        mentioned.select(*keys, F.posexplode("mentioned").alias("pos", "record_id"))
        .join(seen.select(*keys, "record_id").distinct(), [*keys, "record_id"], "left_anti")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "record_id"))).alias("unseen"))
    )
    nothing = F.array().cast("array<string>")
    stripped = F.coalesce(F.transform("unseen", lambda u: u["record_id"]), nothing)
    joined = mentioned.join(unseen, keys, "left").withColumn("stripped_ids", stripped)
    left = F.array_except("answer_ids", "stripped_ids")
    emptied = (F.size("answer_ids") > 0) & (F.size(left) == 0) & ~F.col("abstained")
    text = redact(F.col("answer"), F.col("stripped_ids"))
    return joined.select(
        *keys,
        F.when(emptied, F.concat(text, F.lit(UNVERIFIED_NOTE))).otherwise(text).alias("answer"),
        left.alias("answer_ids"),
        F.array_except("evidence_ids", "stripped_ids").alias("evidence_ids"),
        (F.col("abstained") | emptied).alias("abstained"),
        "stripped_ids",
    )
