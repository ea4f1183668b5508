"""Run analytics: accuracy, noise, cost, error kinds and ablations over tables of answers.

lines: one row per answer (config, repeat, item_id, category, correct, answer_ids, steps, ...).
items: one row per question (item_id, category, gold_ids, forbidden_ids, should_abstain, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.config import (
    BOOTSTRAP_SAMPLES,
    CACHED_STEP_MS,
    EFFECT_NOISE_FACTOR,
    EFFECT_POINTS,
    FAST_ANSWER_MS,
)
from quarrylight.operators.selection import quantiles

# The kinds of wrong answers, in the order they are tested.
ERROR_KINDS = [
    "missing abstain", "needless abstain", "wrong tool or arguments", "retrieval ceiling",
    "over-inclusive", "right tool, wrong reading",
]
# Stop reasons that count as losses to the machinery.
MACHINERY_STOPS = ["parse_failure", "tool_budget", "llm_error"]
KEY = ["config", "repeat", "item_id"]


def complete_lines(lines: DataFrame) -> DataFrame:
    """Lines not flagged incomplete; a missing flag means complete."""
    return lines.where(~F.coalesce("incomplete", F.lit(False)))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL on an empty whole."""
    return part / F.nullif(whole, F.lit(0))


def explode_steps(lines: DataFrame) -> DataFrame:
    """One row per step with its position."""
    return lines.select(
        *KEY, "category", "date", F.posexplode("steps").alias("pos", "step")
    ).select(*KEY, "category", "date", "pos", "step.*")


# ---------------------------------------------------------------- accuracy and its noise


def accuracy(lines: DataFrame, by: list[str]) -> DataFrame:
    """n and share of correct complete answers per group."""
    return complete_lines(lines).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy")
    )


def accuracy_by_repeat(lines: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sample deviation of the accuracy of single repeats; no deviation for one repeat."""
    return accuracy(lines, [*by, "repeat"]).groupBy(*by).agg(
        F.count("*").alias("repeats"), F.avg("accuracy").alias("mean"),
        F.when(F.count("*") >= 2, F.stddev_samp("accuracy")).alias("std"),
    )


def question_means(lines: DataFrame, by: list[str]) -> DataFrame:
    """Mean correctness per question over its repeats."""
    return complete_lines(lines).groupBy(*by, "item_id").agg(
        F.avg(F.col("correct").cast("int")).alias("mean")
    )


def accuracy_by_question(lines: DataFrame, by: list[str]) -> DataFrame:
    """Questions per group and the mean of their means."""
    return question_means(lines, by).groupBy(*by).agg(
        F.count("*").alias("questions"), F.avg("mean").alias("accuracy")
    )


def accuracy_grid(lines: DataFrame) -> DataFrame:
    """Accuracy per configuration and category, with an Overall row per configuration."""
    done = complete_lines(lines)
    grouped = done.groupingSets(
        [["config", "category"], ["config"]], "config", "category"
    ).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy"))
    return grouped.withColumn("category", F.coalesce("category", F.lit("Overall")))


def flip_rate(lines: DataFrame) -> DataFrame:
    """Share of questions whose repeats disagree, per category and Overall of a configuration."""
    flips = complete_lines(lines).groupBy("config", "category", "item_id").agg(
        (F.bool_or("correct") & ~F.bool_and("correct")).cast("int").alias("flipped")
    )
    return flips.groupingSets([["config", "category"], ["config"]], "config", "category").agg(
        F.avg("flipped").alias("flip_rate")
    ).withColumn("category", F.coalesce("category", F.lit("Overall")))


DRAWS_PER_HASH = 4


def poisson_weight(draw: Column) -> Column:
    """A Poisson(1) draw from eight hex digits: how many of the distribution's steps they reach.

    Equally long hex strings compare like the numbers they write. Steps finer than one of the 2^32
    draws cannot be met and end the sum.
    """
    weight, below = F.lit(0), 0.0
    term, k = 0.36787944117144233, 1  # exp(-1)
    while term * 2**32 >= 1:
        below += term
        weight = weight + (draw >= F.lit(f"{int(below * 2**32):08x}")).cast("int")
        term, k = term / k, k + 1
    return weight


def bootstrap_ci(
    means: DataFrame, by: list[str], samples: int = BOOTSTRAP_SAMPLES, seed: int = 0
) -> DataFrame:
    """95 % percentile interval of the mean of question means.

    Every resample draws each question Poisson(1) times, the limit of drawing n of n with
    replacement. The draw is a hash of (resample, question), so it needs no index, no join and no
    generator; one hash serves four resamples, and partial sums leave each task as one row per
    four resamples. Any number of samples from 1 on is drawn in full. The interval bounds are
    the 25th and the 974th of 1000 sorted means, counted from 0.
    """
    spark = means.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("g").cast("string"), F.col("item_id")))
    # A few questions grow a thousandfold here, so they are dealt out to all tasks first.
    hashed = means.repartition(tasks, *by, "item_id").withColumn(
        "g", F.explode(F.sequence(F.lit(0), F.lit((samples - 1) // DRAWS_PER_HASH)))
    ).withColumn("hash", key)
    sums = []
    for part in range(DRAWS_PER_HASH):
        weight = poisson_weight(F.substring("hash", 1 + 8 * part, 8))
        sums.append(F.sum(weight * F.col("mean")).alias(f"w{part}"))
        sums.append(F.sum(weight).alias(f"n{part}"))
    drawn = hashed.groupBy(*by, "g").agg(*sums)
    values = F.array(*[ratio(F.col(f"w{p}"), F.col(f"n{p}")) for p in range(DRAWS_PER_HASH)])
    asked = F.least(F.lit(DRAWS_PER_HASH), samples - F.col("g") * DRAWS_PER_HASH)
    resampled = drawn.select(*by, F.explode(F.slice(values, 1, asked)).alias("value"))
    ordered = F.array_sort(F.collect_list("value"))
    return resampled.groupBy(*by).agg(ordered.alias("v")).select(
        *by,
        F.try_element_at("v", F.lit(int(0.025 * samples) + 1)).alias("low"),
        F.try_element_at("v", F.lit(int(0.975 * samples))).alias("high"),
    )


def abstention_prf(lines: DataFrame, items: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall and false rate of abstaining; NULL where nothing could be abstained."""
    gold = items.select("item_id", F.col("should_abstain").alias("should"))
    done = complete_lines(lines).join(gold, "item_id")
    both = F.count_if(F.col("abstained") & F.col("should"))
    wrong = F.count_if(F.col("abstained") & ~F.col("should"))
    return done.groupBy(*by).agg(
        ratio(both, F.count_if("abstained")).alias("precision"),
        ratio(both, F.count_if("should")).alias("recall"),
        ratio(wrong, F.count_if(~F.col("should"))).alias("false_rate"),
    )


# ---------------------------------------------------------------- cost and operation


def stop_reason_counts(lines: DataFrame) -> DataFrame:
    return complete_lines(lines).groupBy("config", "stopped_reason").agg(F.count("*").alias("n"))


def step_counts() -> dict[str, Column]:
    """Per line: tool steps and failed tool steps; a refused call over budget is no failure."""
    tools = F.filter("steps", lambda s: s["kind"] == "tool")
    failed = F.filter(
        tools,
        lambda s: s["summary"].startswith("error:") & (s["summary"] != "error: BUDGET"),
    )
    return {"tool_steps": F.size(tools), "tool_errors": F.size(failed)}


def nearest_rank_percentiles(lines: DataFrame, by: list[str]) -> DataFrame:
    """p50 and p95 latency: the value at index round_half_even(q * (n - 1))."""
    return quantiles(
        complete_lines(lines), by, "latency_ms", {"p50_ms": 0.50, "p95_ms": 0.95}, nearest=True
    )


def operational_metrics(lines: DataFrame) -> DataFrame:
    """Per configuration: tools and tokens per question, tool errors, latency, invented IDs."""
    done = complete_lines(lines).withColumns(step_counts())
    summary = done.groupBy("config").agg(
        F.avg("tool_calls").alias("tools_per_q"),
        ratio(F.sum("tool_errors"), F.sum("tool_steps")).alias("tool_error_rate"),
        F.avg(F.col("input_tokens") + F.col("output_tokens")).alias("tokens_per_q"),
        F.avg((F.size("stripped_ids") > 0).cast("int")).alias("fabricated_rate"),
    )
    return summary.join(nearest_rank_percentiles(lines, ["config"]), "config")


def planned_vs_answered(lines: DataFrame, items: DataFrame, plan: DataFrame) -> DataFrame:
    """plan(config, category, repeats) -> planned, answered and missing answers per configuration."""
    wanted = (
        plan.join(items.select("item_id", "category"), "category")
        .groupBy("config").agg(F.sum("repeats").alias("planned"))
    )
    answered = complete_lines(lines).groupBy("config").agg(F.count("*").alias("answered"))
    return wanted.join(answered, "config", "left").select(
        "config", "planned", F.coalesce("answered", F.lit(0)).alias("answered"),
        F.greatest(F.col("planned") - F.coalesce("answered", F.lit(0)), F.lit(0)).alias("missing"),
    )


def quota_totals(quota: DataFrame) -> DataFrame:
    """quota(day, requests, tokens) -> totals over all days."""
    return quota.agg(
        F.sum("requests").alias("requests"), F.sum("tokens").alias("tokens"),
        F.count_distinct("day").alias("days"),
    )


CHAR_SOURCES = ["system", "tools", "results", "other"]


def input_composition(lines: DataFrame) -> DataFrame:
    """Characters sent per source and their shares, per category and overall."""
    llm = explode_steps(lines).where("kind = 'llm'")
    total = sum((F.col(f"{s}_chars") for s in CHAR_SOURCES), F.lit(0))
    per_line = llm.groupBy(*KEY, "category").agg(
        F.count("*").alias("turns"), F.sum(total).alias("chars"),
        *[F.sum(f"{s}_chars").alias(f"{s}_chars") for s in CHAR_SOURCES],
    )
    return per_line.rollup("category").agg(
        F.count("*").alias("answers"), F.avg("turns").alias("mean_turns"),
        F.avg("chars").alias("mean_chars"),
        *[ratio(F.sum(f"{s}_chars"), F.sum("chars")).alias(f"{s}_share") for s in CHAR_SOURCES],
    ).withColumn("category", F.coalesce("category", F.lit("Overall")))


def field_share(payloads: DataFrame) -> DataFrame:
    """payloads(tool, payload JSON) -> share of characters per top-level field of a tool.

    A field counts its name, its value and the colon between them.
    """
    sized = payloads.groupBy("tool").agg(F.sum(F.length("payload")).alias("total"))
    fields = payloads.select(
        "tool", "payload", F.explode(F.json_object_keys("payload")).alias("field")
    )
    value = F.expr("get_json_object(payload, concat('$.', field))")
    is_text = F.expr("payload LIKE concat('%\"', field, '\":\"%')")
    chars = F.length("field") + 3 + F.when(
        value.isNull(), 4
    ).otherwise(F.length(value) + F.when(is_text, 2).otherwise(0))
    return fields.groupBy("tool", "field").agg(F.sum(chars).alias("chars")).join(
        sized, "tool"
    ).select("tool", "field", ratio(F.col("chars"), F.col("total")).alias("share"))


def constant_share(payloads: DataFrame) -> DataFrame:
    """Calls, and the share of characters spent on null and on false values, per tool."""
    def spent(word: str) -> Column:
        hits = F.regexp_count("payload", F.lit(f":{word}"))
        return ratio(F.sum(hits) * len(word), F.sum(F.length("payload")))

    return payloads.groupBy("tool").agg(
        F.count("*").alias("calls"), spent("null").alias("null_share"),
        spent("false").alias("false_share"),
    )


def token_estimate(composition: DataFrame, ratios: dict[str, float]) -> DataFrame:
    """Tokens per answer by source: characters times the tokens per character of the source."""
    parts = {
        s: F.col("mean_chars") * F.col(f"{s}_share") * F.lit(float(ratios[s])) for s in CHAR_SOURCES
    }
    total = sum(parts.values(), F.lit(0.0))
    return composition.select(
        "category", total.alias("tokens"),
        *[(parts[s] / total).alias(f"{s}_token_share") for s in CHAR_SOURCES],
        (F.floor(F.col("mean_chars") / 4) + 1).alias("quick_estimate"),
    )


def llm_calls() -> Column:
    return F.size(F.filter("steps", lambda s: s["kind"] == "llm"))


def prompt_version_summary(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Per prompt version: accuracy, abstention and cost; categories as rows of a grouping set."""
    judged = lines.join(items.select("item_id", F.col("should_abstain").alias("should")), "item_id")
    both = F.count_if(F.col("abstained") & F.col("should"))
    return judged.withColumn("calls", llm_calls()).groupingSets(
        [["prompt_version", "category"], ["prompt_version"]], "prompt_version", "category"
    ).agg(
        F.count("*").alias("answers"), F.count_if("correct").alias("correct"),
        ratio(both, F.count_if("abstained")).alias("abstain_precision"),
        ratio(both, F.count_if("should")).alias("abstain_recall"),
        F.avg("calls").alias("calls_per_answer"),
        F.avg("input_tokens").alias("input_tokens_per_answer"),
    ).withColumn("category", F.coalesce("category", F.lit("Overall")))


def mixed_versions(lines: DataFrame) -> DataFrame:
    """Files holding more than one prompt version; their summaries are refused."""
    return lines.groupBy("file_name").agg(
        F.count_distinct("prompt_version").alias("versions")
    ).where("versions > 1")


def candidate_summary(
    lines: DataFrame, planned: DataFrame, limits: DataFrame, plan_answers: int, max_days: int
) -> DataFrame:
    """One candidate per configuration: losses, calls, and whether the plan fits the quota.

    planned(config, planned); limits(config, rpd).
    """
    done = lines.withColumn("calls", llm_calls()).groupBy("config").agg(
        F.count("*").alias("answered"),
        F.count_if(F.col("stopped_reason").isin(MACHINERY_STOPS)).alias("machinery"),
        F.avg(F.col("correct").cast("int")).alias("accuracy"),
        F.avg("calls").alias("calls_per_answer"),
    )
    unanswered = F.greatest(F.col("planned") - F.coalesce("answered", F.lit(0)), F.lit(0))
    plan_calls = F.rint(F.coalesce("calls_per_answer", F.lit(0.0)) * plan_answers).cast("bigint")
    days = F.ceil(plan_calls / F.nullif("rpd", F.lit(0)))
    return planned.join(done, "config", "left").join(limits, "config", "left").select(
        "config", "planned", F.coalesce("answered", F.lit(0)).alias("answered"),
        unanswered.alias("unanswered"),
        (F.coalesce("machinery", F.lit(0)) + unanswered).alias("losses"),
        "accuracy", "calls_per_answer", plan_calls.alias("plan_calls"), days.alias("plan_days"),
        F.coalesce(days <= max_days, F.lit(False)).alias("feasible"),
    )


def choose_candidate(candidates: DataFrame) -> DataFrame:
    """The feasible candidate with fewest losses, then highest accuracy, then not "lite".

    candidates come from candidate_summary, one row each. waiting counts feasible candidates
    that still have questions to answer; while any does, nothing is chosen.
    """
    feasible = candidates.where("feasible")
    lite = F.col("config").contains("lite")
    best = feasible.agg(
        F.min_by("config", F.struct("losses", -F.col("accuracy"), lite, "config")).alias("best"),
        F.count_if(F.col("unanswered") > 0).alias("waiting"), F.count("*").alias("feasible"),
    )
    return best.select(
        F.when((F.col("waiting") == 0) & (F.col("feasible") > 0), F.col("best")).alias("chosen"),
        "waiting", "feasible",
    )


def requests_spent() -> Column:
    """Model calls that reached the provider; a cached one returns faster."""
    return F.size(
        F.filter("steps", lambda s: (s["kind"] == "llm") & (s["duration_ms"] >= CACHED_STEP_MS))
    )


def requests_per_config(lines: DataFrame) -> DataFrame:
    """Per configuration: answers, requests, rate, median latency, free and fast answers."""
    spent = lines.withColumn("spent", requests_spent())
    summary = spent.groupBy("config").agg(
        F.count("*").alias("answers"), F.sum("spent").alias("requests"),
        ratio(F.sum("spent"), F.count("*")).alias("per_answer"),
        F.count_if(F.col("spent") == 0).alias("free_answers"),
        F.count_if(F.col("latency_ms") < FAST_ANSWER_MS).alias("fast_answers"),
    )
    return summary.join(
        quantiles(lines, ["config"], "latency_ms", {"median_latency_ms": 0.5}), "config"
    )


def latency_gap(lines: DataFrame) -> DataFrame:
    """Slowest model step under the cache threshold and fastest one at or above it."""
    llm = explode_steps(lines).where("kind = 'llm'")
    cached = F.col("duration_ms") < CACHED_STEP_MS
    return llm.agg(
        F.max(F.when(cached, F.col("duration_ms"))).alias("slowest_cached_ms"),
        F.min(F.when(~cached, F.col("duration_ms"))).alias("fastest_live_ms"),
    )


def shared_traces(lines: DataFrame) -> DataFrame:
    """Questions answered by several configurations, and how many share a tool trace.

    A trace is the ordered list of tool calls with their arguments, compared by its hash.
    """
    calls = F.transform(
        F.filter("steps", lambda s: s["kind"] == "tool"),
        lambda s: F.concat_ws(" ", s["name"], s["arguments"]),
    )
    traced = lines.select("item_id", "config", F.sha2(F.array_join(calls, "\n"), 256).alias("trace"))
    per_trace = traced.groupBy("item_id", "trace").agg(
        F.count_distinct("config").alias("same"), F.min("config").alias("low"),
        F.max("config").alias("high"),
    )
    per_item = per_trace.groupBy("item_id").agg(
        F.max("same").alias("same"), F.min("low").alias("low"), F.max("high").alias("high")
    ).where("low <> high")
    return per_item.agg(
        F.count("*").alias("comparable"), F.count_if(F.col("same") > 1).alias("shared")
    )


# ---------------------------------------------------------------- what went wrong


def missing_id_types(lines: DataFrame, items: DataFrame, by: list[str]) -> DataFrame:
    """Gold IDs left out of wrong answers that did answer, counted by ID prefix."""
    wrong = complete_lines(lines).where("NOT correct AND NOT abstained")
    gold = items.select("item_id", F.col("gold_ids").alias("wanted"))
    missing = wrong.join(gold, "item_id").select(
        *by, F.explode(F.array_except("wanted", "answer_ids")).alias("missing_id")
    )
    return missing.groupBy(*by, F.split("missing_id", "-")[0].alias("id_type")).agg(
        F.count("*").alias("missing")
    )


def correct_call(gold_type: Column, node_id: Column, depth: Column) -> Column:
    """Did a tool step make the call the question needs? NULL where no single call is right."""

    def traced(direction: str) -> Column:
        return F.exists(
            "steps",
            lambda s: (s["kind"] == "tool") & (s["name"] == "trace_lineage")
            & (F.get_json_object(s["arguments"], "$.node_id") == node_id)
            & (F.get_json_object(s["arguments"], "$.direction") == direction)
            & (F.get_json_object(s["arguments"], "$.depth").cast("int") == depth),
        )

    impact = F.exists(
        "steps",
        lambda s: (s["kind"] == "tool") & (s["name"] == "impact_analysis")
        & (F.get_json_object(s["arguments"], "$.table_id") == node_id),
    )
    return (
        F.when(gold_type == "upstream_tables", F.coalesce(traced("upstream"), F.lit(False)))
        .when(gold_type == "downstream_reports", F.coalesce(traced("downstream"), F.lit(False)))
        .when(gold_type == "impact_notify", F.coalesce(impact, F.lit(False)))
    )


def judged_lines(lines: DataFrame, items: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """Complete lines with right_call, gold_unseen, over_inclusive and error_kind (wrong ones).

    shown(config, repeat, item_id, record_id) holds, in long form, what replayed tool calls
    returned; an answer it does not cover falls back to the summaries of its steps.
    """
    gold = items.select(
        "item_id", "gold_ids", "forbidden_ids", "should_abstain", "gold_type", "node_id", "depth"
    )
    judged = complete_lines(lines).join(gold, "item_id")
    text = F.array_join(
        F.transform(F.filter("steps", lambda s: s["kind"] == "tool"), lambda s: s["summary"]), " "
    )
    in_text = F.exists("gold_ids", lambda g: F.contains(text, g))
    if shown is None:
        judged = judged.withColumn("gold_seen", in_text)
    else:
        covered = shown.select(*KEY).distinct().withColumn("covered", F.lit(True))
        wanted = judged.select(*KEY, F.explode("gold_ids").alias("record_id"))
        seen = (
            wanted.join(shown.select(*KEY, "record_id").distinct(), [*KEY, "record_id"], "left_semi")
            .select(*KEY).distinct().withColumn("replayed", F.lit(True))
        )
        judged = judged.join(covered, KEY, "left").join(seen, KEY, "left").withColumn(
            "gold_seen",
            F.when(F.col("covered"), F.coalesce("replayed", F.lit(False))).otherwise(in_text),
        ).drop("covered", "replayed")
    any_gold = F.size("gold_ids") > 0
    unseen = any_gold & ~F.col("gold_seen")
    all_given = any_gold & (F.size(F.array_except("gold_ids", "answer_ids")) == 0)
    over = all_given & (F.size(F.array_except("answer_ids", "gold_ids")) > 0)
    judged = judged.withColumns(
        {
            "right_call": correct_call(F.col("gold_type"), F.col("node_id"), F.col("depth")),
            "gold_unseen": unseen,
            "over_inclusive": over,
        }
    )
    kind = (
        F.when(F.col("should_abstain"), ERROR_KINDS[0])
        .when(F.col("abstained"), ERROR_KINDS[1])
        .when(F.col("right_call") == F.lit(False), ERROR_KINDS[2])
        .when(F.col("gold_unseen"), ERROR_KINDS[3])
        .when(F.col("over_inclusive"), ERROR_KINDS[4])
        .otherwise(ERROR_KINDS[5])
    )
    return judged.withColumn("error_kind", F.when(~F.col("correct"), kind))


def error_kind_counts(judged: DataFrame, by: list[str]) -> DataFrame:
    """Wrong answers per group, one column per kind, and how many never saw a gold ID."""
    return judged.where("NOT correct").groupBy(*by).agg(
        F.count("*").alias("wrong"),
        *[F.count_if(F.col("error_kind") == k).alias(k.replace(" ", "_").replace(",", "")
                                                     .replace("-", "_")) for k in ERROR_KINDS],
        F.count_if("gold_unseen").alias("gold_never_retrieved"),
    )


def representative_failures(judged: DataFrame, by: list[str], per_group: int = 3) -> DataFrame:
    """Up to three wrong answers per group: the first of each kind, then in ID order.

    A question is used once. The reference picks greedily; here a question is represented by its
    first failure, the first question of each kind comes first, and the rest follows in ID order.
    """
    wrong = judged.where("NOT correct")
    one = Window.partitionBy(*by, "item_id").orderBy("repeat")
    first = wrong.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    per_kind = first.groupBy(*by, "error_kind").agg(F.min("item_id").alias("_first"))
    marked = first.join(per_kind, [*by, "error_kind"])
    order = Window.partitionBy(*by).orderBy(
        F.when(F.col("item_id") == F.col("_first"), 0).otherwise(1), "item_id", "repeat"
    )
    chosen = marked.withColumn("_place", F.row_number().over(order)).where(
        F.col("_place") <= per_group
    )
    missing = F.array_sort(F.array_except("gold_ids", "answer_ids"))
    forbidden = F.array_sort(F.array_intersect("forbidden_ids", "answer_ids"))
    extra = F.array_sort(
        F.array_except(F.array_except("answer_ids", "gold_ids"), F.col("forbidden_ids"))
    )
    return chosen.select(
        *by, "item_id", "repeat", "error_kind", missing.alias("missing_ids"),
        forbidden.alias("forbidden_given"), extra.alias("extra_ids"), "stopped_reason",
        "tool_calls",
    )


def diagnostics(judged: DataFrame, by: list[str]) -> DataFrame:
    """Per group and category (L6 left out): what explains a score without changing it."""
    in_cluster = F.size(F.filter("answer_ids", lambda i: F.array_contains("gold_ids", i)))
    share = F.when(
        (F.col("category") == "L4") & (F.size("answer_ids") > 0), in_cluster / F.size("answer_ids")
    )
    return judged.where("category <> 'L6'").groupBy(*by, "category").agg(
        F.avg(F.col("over_inclusive").cast("int")).alias("over_inclusive_rate"),
        F.count_if(~F.col("correct")).alias("wrong_answers"),
        F.count_if(~F.col("correct") & F.col("gold_unseen")).alias("wrong_with_gold_unseen"),
        F.avg(F.col("right_call").cast("int")).alias("tool_args_correct"),
        F.avg(F.when(F.col("right_call"), F.col("correct").cast("int")))
        .alias("accuracy_when_args_correct"),
        F.avg(share).alias("in_cluster_precision"),
    )


def replay_coverage(lines: DataFrame, shown: DataFrame) -> DataFrame:
    """Complete answers, and how many of them the replayed calls cover."""
    covered = shown.select(*KEY).distinct().withColumn("covered", F.lit(True))
    return complete_lines(lines).join(covered, KEY, "left").agg(
        F.count("covered").alias("covered"), F.count("*").alias("answers")
    )


def determinism_check(lines: DataFrame) -> DataFrame:
    """Per configuration: questions, questions whose repeats agree, and whose texts are equal."""
    per_question = complete_lines(lines).groupBy("config", "item_id").agg(
        (F.bool_or("correct") == F.bool_and("correct")).alias("agrees"),
        (F.min("answer") == F.max("answer")).alias("same_text"),
    )
    return per_question.groupBy("config").agg(
        F.count("*").alias("questions"), F.count_if("agrees").alias("agreeing"),
        F.count_if("same_text").alias("identical_texts"),
    )


def retrieval_ceiling(judged: DataFrame) -> DataFrame:
    """Per configuration: wrong answers, and those never shown a gold ID."""
    return judged.where("NOT correct").groupBy("config").agg(
        F.count("*").alias("wrong"), F.count_if("gold_unseen").alias("unseen"),
        F.avg(F.col("gold_unseen").cast("int")).alias("share"),
    )


# ---------------------------------------------------------------- ablations


def effect_marks(lines: DataFrame, baseline: str = "A0") -> DataFrame:
    """Every configuration against the full one: overall difference and its mark.

    An effect is at least 3 points and more than twice the deviation of the full system's
    repeats; within one deviation counts as equal. Both need two full-system repeats.
    """
    overall = accuracy(lines, ["config"]).select("config", "accuracy")
    full = accuracy_by_repeat(lines.where(F.col("config") == baseline), ["config"])
    mean, std = full.select("mean").scalar(), full.select("std").scalar()
    compared = overall.where(F.col("config") != baseline).select(
        "config", "accuracy", mean.alias("full"), std.alias("std")
    )
    difference = F.col("accuracy") - F.col("full")
    effect = (F.abs(difference) >= EFFECT_POINTS) & (
        F.abs(difference) > EFFECT_NOISE_FACTOR * F.col("std")
    )
    mark = (
        F.when(F.col("std").isNull(), "")
        .when(effect & (difference > 0), "up")
        .when(effect, "down")
        .when(F.abs(difference) <= F.col("std"), "equal")
        .otherwise("")
    )
    return compared.select("config", "accuracy", difference.alias("difference"), mark.alias("mark"))


def category_marks(lines: DataFrame, baseline: str = "A0") -> DataFrame:
    """Category cells: an effect when the bootstrap intervals do not overlap, else equal when
    within one deviation of the full system's repeats."""
    cells = ["config", "category"]
    intervals = bootstrap_ci(question_means(lines, cells), cells)
    values = accuracy(lines, cells).join(intervals, cells)
    spread = accuracy_by_repeat(lines, cells)
    full = (
        values.join(spread, cells).where(F.col("config") == baseline)
        .select("category", F.col("low").alias("full_low"), F.col("high").alias("full_high"),
                F.col("mean").alias("full_mean"), F.col("std").alias("full_std"))
    )
    mark = (
        F.when(F.col("low") > F.col("full_high"), "up")
        .when(F.col("high") < F.col("full_low"), "down")
        .when(F.abs(F.col("accuracy") - F.col("full_mean")) <= F.col("full_std"), "equal")
        .otherwise("")
    )
    # One row per category of the baseline: as many rows as there are categories.
    return values.where(F.col("config") != baseline).join(F.broadcast(full), "category").select(
        *cells, "n", "accuracy", mark.alias("mark")
    )


def ablation_table(lines: DataFrame, items: DataFrame, baseline: str = "A0") -> DataFrame:
    """Per configuration: accuracy per category and overall, difference, abstention and cost."""
    grid = accuracy_grid(lines).groupBy("config").pivot(
        "category", ["L1", "L2", "L3", "L4", "L5", "L6", "MX", "Overall"]
    ).agg(F.max("accuracy"))
    full = accuracy_by_repeat(lines.where(F.col("config") == baseline), ["config"])
    return (
        grid.join(abstention_prf(lines, items, ["config"]), "config")
        .join(operational_metrics(lines), "config")
        .withColumn("delta", F.col("Overall") - full.select("mean").scalar())
        .select(
            "config", "L1", "L2", "L3", "L4", "L5", "L6", "MX", "Overall", "delta", "precision",
            "recall", "false_rate", "fabricated_rate", "tools_per_q", "tokens_per_q", "p95_ms",
        )
    )


def ablation_reading(lines: DataFrame, baseline: str = "A0") -> DataFrame:
    """effect_marks with the noisiest category of the full system and the caveats that apply."""
    flips = flip_rate(lines.where(F.col("config") == baseline)).where("category <> 'Overall'")
    worst = flips.agg(
        F.max_by("category", F.struct("flip_rate", "category")).alias("category"),
        F.max("flip_rate").alias("flip_rate"),
    )
    std = accuracy_by_repeat(lines.where(F.col("config") == baseline), ["config"])
    return effect_marks(lines, baseline).select(
        "*",
        worst.select("category").scalar().alias("noisiest_category"),
        worst.select("flip_rate").scalar().alias("noisiest_flip_rate"),
        F.coalesce(std.select("std").scalar() == 0, F.lit(False)).alias("zero_noise"),
        (F.col("difference") > 0).alias("beats_full"),
    )


def ablation_shift(judged: DataFrame, baseline: str = "A0") -> DataFrame:
    """Answers, wrong answers and error kinds per repeat and configuration, on the categories
    the configuration ran, next to the full system's."""
    per = judged.groupBy("config", "category").agg(
        F.count("*").alias("answers"), F.count_if(~F.col("correct")).alias("wrong"),
        F.count_distinct("repeat").alias("repeats"),
        *[F.count_if(F.col("error_kind") == k).alias(f"kind_{n}") for n, k in enumerate(ERROR_KINDS)],
    )
    repeats = judged.groupBy("config").agg(F.count_distinct("repeat").alias("n_repeats"))
    counts = ["answers", "wrong", *[f"kind_{n}" for n in range(len(ERROR_KINDS))]]
    mine = per.groupBy("config").agg(*[F.sum(c).alias(c) for c in counts]).join(repeats, "config")
    mine = mine.select("config", *[(F.col(c) / F.col("n_repeats")).alias(c) for c in counts])
    ran = per.select("config", "category").where(F.col("config") != baseline)
    full = per.where(F.col("config") == baseline).drop("config")
    n_full = repeats.where(F.col("config") == baseline).select("n_repeats").scalar()
    theirs = ran.join(full, "category").groupBy("config").agg(
        *[F.sum(c).alias(f"full_{c}") for c in counts]
    ).select("config", *[(F.col(f"full_{c}") / n_full).alias(f"full_{c}") for c in counts])
    return mine.join(theirs, "config")


def component_gap(lines: DataFrame, items: DataFrame, baseline: str = "A0") -> DataFrame:
    """Per configuration: the ID type it leaves out most beyond the full system, per repeat.

    NULL where it leaves out no type more often.
    """
    missing = missing_id_types(lines, items, ["config"])
    repeats = complete_lines(lines).groupBy("config").agg(
        F.count_distinct("repeat").alias("repeats")
    )
    rates = missing.join(repeats, "config").select(
        "config", "id_type", (F.col("missing") / F.col("repeats")).alias("rate")
    )
    full = rates.where(F.col("config") == baseline).select("id_type", F.col("rate").alias("full"))
    types = rates.agg(F.collect_set("id_type")).scalar()
    cells = repeats.where(F.col("config") != baseline).select(
        "config", F.explode(types).alias("id_type")
    )
    gaps = cells.join(rates, ["config", "id_type"], "left").join(full, "id_type", "left").select(
        "config", "id_type",
        (F.coalesce("rate", F.lit(0.0)) - F.coalesce("full", F.lit(0.0))).alias("gap"),
    )
    best = gaps.groupBy("config").agg(
        F.max_by("id_type", F.struct("gap", "id_type")).alias("id_type"), F.max("gap").alias("gap")
    )
    holds = F.col("gap") > 0
    return best.select(
        "config", F.when(holds, F.col("id_type")).alias("id_type"),
        F.when(holds, F.col("gap")).alias("gap"),
    )
