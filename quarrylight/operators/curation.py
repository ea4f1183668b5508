"""Building evaluation sets: eligible targets, leak checks and choices by hash order.

Where the reference draws at random, rows are ordered by the md5 of a seed and their key: the
choice is fixed, independent of partitions, and the first n of a group need no full sort.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.config import NOTIFY_DETAIL_MAX
from quarrylight.functions.scalars import packed_list
from quarrylight.functions.text import (
    FUNCTION_WORDS,
    content_overlap,
    name_overlap,
    word_set,
    words_array,
)
from quarrylight.operators import gold, lineage
from quarrylight.operators.impact import notify_modes
from quarrylight.operators.quality import broken, summarize
from quarrylight.operators.scoring import scoring_rule
from quarrylight.operators.search import name_in_query
from quarrylight.operators.skew import value_ranks
from quarrylight.sources.catalog import Catalog, metric_sources
from quarrylight.sources.staging import stage

# Limits of the leak checks and of lineage answers.
MAX_NAME_OVERLAP = 0.30
MAX_TEXT_OVERLAP = 0.20
LINEAGE_SIZE = (2, 15)


def hash_order(seed: str, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *keys))


def first_by_hash(df: DataFrame, group: list[str], key: str, n: int, seed: str) -> DataFrame:
    """The first n rows per group in hash order, with their place."""
    order = Window.partitionBy(*group).orderBy(hash_order(seed, key), key)
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def active_reports(catalog: Catalog, without: DataFrame | None = None) -> DataFrame:
    """Active reports, without the given members(report_id) when asked."""
    active = catalog.reports.where(F.col("status") == "active")
    return active if without is None else active.join(without, "report_id", "left_anti")


def noise_members(pairs: DataFrame, replaced: DataFrame) -> DataFrame:
    """Reports in a designed near-duplicate or replacement pair(a, b)."""
    return pairs.union(replaced).select(F.explode(F.array("a", "b")).alias("report_id")).distinct()


def unique_combos(traits: DataFrame) -> DataFrame:
    """Reports that are alone with their (subject, qualifier)."""
    alone = traits.groupBy("subject", "qualifier").agg(
        F.count("*").alias("n"), F.min("report_id").alias("report_id")
    )
    return alone.where("n = 1").select("report_id", "subject", "qualifier")


def unambiguous_aliases(catalog: Catalog) -> DataFrame:
    """Acronym aliases of exactly one metric that are no report tag."""
    aliases = catalog.metrics.select("metric_id", F.explode(packed_list(F.col("aliases"))).alias("alias"))
    single = (
        aliases.where(F.col("alias").rlike("^[A-Z0-9%&]{2,}$"))
        .groupBy("alias").agg(F.count_distinct("metric_id").alias("n"), F.min("metric_id").alias("metric_id"))
        .where("n = 1")
        .withColumn("word", F.regexp_replace("alias", "%+$", ""))
    )
    tags = catalog.reports.select(F.explode(packed_list(F.col("tags"))).alias("word")).distinct()
    return single.join(tags, "word", "left_anti").select("alias", "metric_id")


def paraphrase_candidates(
    catalog: Catalog, eligible: DataFrame, topics: DataFrame, dimensions: DataFrame,
    templates: list[str], seed: str,
) -> DataFrame:
    """One leak-free paraphrase per subject: eligible(report_id, subject, qualifier) joined to the
    phrases of its subject (topics) and qualifier (dimensions), put into a template.

    A query must share at most 30 % of the target's name and at most 20 % of its own content
    words with the target's description and tags.
    """
    made = (
        eligible.join(topics.select("subject", F.col("phrase").alias("topic")), "subject")
        .join(dimensions.select("qualifier", F.col("phrase").alias("dimension")), "qualifier")
        .withColumn("template", F.explode(words_array(templates)))
    )
    text = F.replace(
        F.replace(F.col("template"), F.lit("{topic}"), F.col("topic")),
        F.lit("{dimension}"), F.col("dimension"),
    )
    reports = catalog.reports.select("report_id", "name", "description", "tags")
    frame = F.array_distinct(
        F.flatten(F.array(*[word_set(F.regexp_replace(F.lit(t), r"\{[a-z_]+\}", " ")) for t in templates]))
    )
    target_text = F.concat_ws(" ", "description", "tags")
    clean = made.withColumn("query", text).join(reports, "report_id").where(
        (name_overlap(F.col("query"), F.col("name")) <= MAX_NAME_OVERLAP)
        & (content_overlap(F.col("query"), target_text, frame) <= MAX_TEXT_OVERLAP)
    )
    return first_by_hash(clean, ["subject"], "query", 1, seed).select("subject", "report_id", "query")


def disambiguation_items(catalog: Catalog, pairs: DataFrame) -> DataFrame:
    """pairs(a, b) -> the active member as target, the other one forbidden; the first if both are."""
    status = catalog.reports.select("report_id", "status")
    both = (
        pairs.join(status.select(F.col("report_id").alias("a"), F.col("status").alias("sa")), "a")
        .join(status.select(F.col("report_id").alias("b"), F.col("status").alias("sb")), "b")
        .where("sa = 'active' OR sb = 'active'")
    )
    first = F.col("sa") == "active"
    return both.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("target_id"),
        F.when(first, F.col("b")).otherwise(F.col("a")).alias("forbidden_id"),
    )


def negative_names(
    fragments: DataFrame, prefixes: list[str], formats: list[str], names: DataFrame
) -> DataFrame:
    """Made-up names (prefix fragment format) that hold no existing name on word borders.

    fragments(fragment); names as search.exact_names gives them.
    """
    made = fragments.select(
        F.explode(words_array(prefixes)).alias("prefix"), "fragment"
    ).select("prefix", "fragment", F.explode(words_array(formats)).alias("format"))
    candidates = made.select(
        F.concat("prefix", F.lit(" "), "fragment", "format").alias("name")
    ).distinct()
    asked = candidates.select(F.col("name").alias("query_id"), F.col("name").alias("text"))
    existing = name_in_query(asked, names).select(F.col("query_id").alias("name")).distinct()
    return candidates.join(existing, "name", "left_anti")


def exact_items(catalog: Catalog, noise: DataFrame, n: int, seed: str) -> DataFrame:
    """n targets per flavour in hash order: table names, unambiguous acronyms, plain report IDs."""
    tables = catalog.tables.select(
        F.lit("table name").alias("flavour"), F.col("table_id").alias("target_id"), F.col("name").alias("asked")
    )
    acronyms = unambiguous_aliases(catalog).select(
        F.lit("metric acronym").alias("flavour"), F.col("metric_id").alias("target_id"),
        F.col("alias").alias("asked"),
    )
    plain = catalog.reports.join(noise, "report_id", "left_anti").select(
        F.lit("report ID").alias("flavour"), F.col("report_id").alias("target_id"),
        F.col("report_id").alias("asked"),
    )
    return first_by_hash(tables.union(acronyms).union(plain), ["flavour"], "target_id", n, seed)


def chain_targets(catalog: Catalog, chains: DataFrame, rounds: int, seed: str) -> DataFrame:
    """Reports of chain heads, round-robin: round 1 holds one report per head, and so on.

    chains(code, chain). A chain belongs wholly to the test or the dev set, by its hash.
    """
    heads = chains.select("code", F.col("chain")[0].alias("owner_id"))
    heads = heads.withColumn(
        "split", F.when(F.substring(hash_order(seed, "owner_id"), 1, 1) < "a", "test").otherwise("dev")
    )
    owned = active_reports(catalog).select("owner_id", "report_id").join(heads, "owner_id")
    return first_by_hash(owned, ["owner_id"], "report_id", rounds, seed).select(
        "code", "split", F.col("place").alias("round"), F.col("owner_id").alias("head_id"), "report_id"
    )


def lineage_sizes(catalog: Catalog, without_formula: DataFrame) -> DataFrame:
    """(subtype, node, depth, size): gold sizes of lineage questions at the allowed depths and 6.

    Nodes and their distances are found once; the size at a depth is a count of distances.
    """
    metrics = catalog.metrics.join(without_formula, "metric_id", "left_anti")
    up = metrics.select(F.lit("metric_upstream").alias("subtype"), F.col("metric_id").alias("seed"),
                        F.array(F.lit(3), F.lit(6)).alias("depths")).union(
        active_reports(catalog).select(F.lit("report_upstream"), "report_id",
                                       F.array(F.lit(2), F.lit(3), F.lit(6)))
    )
    down = catalog.tables.where("layer = 'staging'").select(
        F.lit("staging_downstream").alias("subtype"), F.col("table_id").alias("seed"),
        F.array(F.lit(2), F.lit(3), F.lit(4), F.lit(6)).alias("depths"),
    )
    asked_up = up.select("subtype", "seed", F.explode("depths").alias("depth"))
    asked_down = down.select("subtype", "seed", F.explode("depths").alias("depth"))

    def sizes(walk: Callable[[Catalog, DataFrame], DataFrame], asked: DataFrame) -> DataFrame:
        deepest = asked.groupBy("seed").agg(F.max("depth").alias("depth"))
        counts = walk(catalog, deepest).groupBy("seed", "distance").agg(F.count("*").alias("n"))
        met = asked.select("seed", "depth").distinct().join(counts, "seed").where("distance <= depth")
        return met.groupBy("seed", "depth").agg(F.sum("n").alias("size"))

    found = sizes(lineage.upstream_tables, asked_up).union(sizes(lineage.downstream_reports, asked_down))
    return asked_up.union(asked_down).join(found, ["seed", "depth"], "left").select(
        "subtype", F.col("seed").alias("node"), "depth", F.coalesce("size", F.lit(0)).alias("size")
    )


def lineage_targets(sizes: DataFrame) -> DataFrame:
    """Nodes and depths whose gold has 2 to 15 IDs."""
    low, high = LINEAGE_SIZE
    return sizes.where((F.col("depth") < 6) & F.col("size").between(low, high))


def lineage_pool_stats(sizes: DataFrame) -> DataFrame:
    """Per subtype: candidates kept, too small or too large at every depth, and the upper median
    of the full lineage size of kept and removed ones."""
    low, high = LINEAGE_SIZE
    asked = F.col("depth") < 6  # depth 6 only measures the full lineage
    fits = asked & F.col("size").between(low, high)
    nodes = sizes.groupBy("subtype", "node").agg(
        F.bool_or(fits).alias("kept"),
        F.max(F.when(asked, F.col("size"))).alias("largest"),
        F.max(F.when(F.col("depth") == 6, F.col("size"))).alias("full"),
    )
    counts = nodes.groupBy("subtype").agg(
        F.count("*").alias("candidates"), F.count_if("kept").alias("kept_n"),
        F.count_if(~F.col("kept") & (F.col("largest") < low)).alias("too_few"),
        F.count_if(~F.col("kept") & (F.col("largest") >= low)).alias("too_many"),
    )
    ranks = value_ranks(nodes, ["subtype", "kept"], "full")
    middle = F.floor(F.col("total") / 2)
    at_middle = (F.col("before") <= middle) & (middle < F.col("before") + F.col("n"))
    medians = ranks.groupBy("subtype").agg(
        F.max(F.when(at_middle & F.col("kept"), F.col("full"))).alias("kept_median"),
        F.max(F.when(at_middle & ~F.col("kept"), F.col("full"))).alias("removed_median"),
    )
    return counts.join(medians, "subtype", "left")


def topic_targets(
    topics: DataFrame, texts: DataFrame, phrases: DataFrame, template: str, seed: str
) -> DataFrame:
    """One question per topic that borrows at most 20 % of its content words from the topic's
    requests: topics(request_id, topic_key), texts(request_id, text), phrases(topic_key, phrase).

    Both sides are compared as words in long form, so a topic's texts are never put together.
    """
    function_words = words_array(FUNCTION_WORDS)
    frame = word_set(F.regexp_replace(F.lit(template), r"\{[a-z_]+\}", " "))
    asked = phrases.select(
        "topic_key", F.replace(F.lit(template), F.lit("{topic}"), F.col("phrase")).alias("question")
    ).distinct()
    content = F.array_except(F.array_except(word_set(F.col("question")), frame), function_words)
    wanted = asked.withColumn("content", content)
    spread = wanted.select("topic_key", "question", F.explode("content").alias("word"))
    held = topics.join(texts, "request_id").select(
        "topic_key", F.explode(word_set(F.col("text"))).alias("word")
    ).distinct()
    shared = spread.join(held, ["topic_key", "word"], "left_semi").groupBy("topic_key", "question").agg(
        F.count("*").alias("shared")
    )
    clean = wanted.join(shared, ["topic_key", "question"], "left").withColumn(
        "overlap",
        F.when(F.size("content") > 0, F.coalesce("shared", F.lit(0)) / F.size("content"))
        .otherwise(F.lit(0.0)),
    ).where(F.col("overlap") <= MAX_TEXT_OVERLAP)
    return first_by_hash(clean, ["topic_key"], "question", 1, seed).select(
        "topic_key", "question", "overlap"
    )


def impact_targets(catalog: Catalog) -> DataFrame:
    """Tables for impact questions: individual ones with 2 to 20 people, by layer, and broadcast
    ones whose answer leaves out at least one head; head_set names the heads of the answer."""
    modes = notify_modes(catalog).join(catalog.tables.select("table_id", "layer"), "table_id")
    individual = modes.where(F.col("notify_total_count").between(2, NOTIFY_DETAIL_MAX)).select(
        "table_id", F.lit("individual").alias("subtype"),
        F.when(F.col("layer") == "mart", "mart").otherwise("other").alias("layer"),
        F.lit(None).cast("string").alias("head_set"),
    )
    # At most one head per department is collected per table.
    sets = gold.impact_notify(catalog).where("min_mentioned_count IS NOT NULL").groupBy("table_id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("forbidden"), F.col("record_id")))), ",")
        .alias("head_set"),
        F.bool_or("forbidden").alias("selective"),
    )
    broadcast = sets.where("selective").select(
        "table_id", F.lit("broadcast").alias("subtype"), F.lit(None).cast("string").alias("layer"),
        "head_set",
    )
    return individual.union(broadcast)


def broadcast_plan(targets: DataFrame, root: str, n: int, seed: str) -> DataFrame:
    """n broadcast tables with pairwise different head sets, as few as possible naming the root.

    Sets without the root come first, then hash order: the first n distinct sets are the choice
    with the fewest. Distinct sets are few (subsets of the departments); each gives one table.
    """
    sets = targets.where("subtype = 'broadcast'").groupBy("head_set").agg(
        F.count("*").alias("tables"),
        F.min_by("table_id", F.struct(hash_order(seed, "table_id"), "table_id")).alias("table_id"),
    ).withColumn("names_root", F.array_contains(F.split("head_set", ","), root).cast("int"))
    return sets.orderBy("names_root", hash_order(seed, "head_set"), "head_set").limit(n)


def abstain_targets(parts: dict[str, DataFrame], n: int, seed: str) -> DataFrame:
    """Unanswerable subtypes: parts(subtype -> df(target)) -> the first n of each in hash order."""
    rows = [df.select(F.lit(name).alias("subtype"), F.col("target").cast("string").alias("target"))
            for name, df in parts.items()]
    return first_by_hash(reduce(DataFrame.union, rows), ["subtype"], "target", n, seed)


def chained_targets(catalog: Catalog, topics: DataFrame) -> DataFrame:
    """(subtype, target, step_target) of questions answered in two steps.

    metric_owners: metrics with a formula whose source tables are all in individual mode.
    deprecated_replacement: deprecated reports with an active replacement.
    request_report: topics whose requests produced exactly one report, and it is active.
    """
    wide = notify_modes(catalog).where("notify_mode = 'broadcast'").select("table_id")
    blocked = metric_sources(catalog).join(wide, "table_id", "left_semi").select("metric_id").distinct()
    owners = catalog.metrics.where("formula IS NOT NULL").join(blocked, "metric_id", "left_anti").select(
        F.lit("metric_owners").alias("subtype"), F.col("metric_id").alias("target"),
        F.lit(None).cast("string").alias("step_target"),
    )
    active = active_reports(catalog).select(F.col("report_id").alias("step_target"))
    replaced = catalog.reports.where("status = 'deprecated'").select(
        F.lit("deprecated_replacement").alias("subtype"), F.col("report_id").alias("target"),
        F.col("replaced_by_report_id").alias("step_target"),
    ).join(active, "step_target", "left_semi")
    produced = topics.join(catalog.requests, "request_id").where(
        "resulting_report_id IS NOT NULL"
    ).groupBy("topic_key").agg(
        F.min("resulting_report_id").alias("low"), F.max("resulting_report_id").alias("high")
    ).where("low = high")
    report = produced.select(
        F.lit("request_report").alias("subtype"), F.col("topic_key").alias("target"),
        F.col("low").alias("step_target"),
    ).join(active, "step_target", "left_semi")
    columns = ["subtype", "target", "step_target"]
    return owners.select(columns).union(replaced.select(columns)).union(report.select(columns))


def allocate_targets(
    candidates: DataFrame, plan: list[tuple[str, str, int]], order: list[str], seed: str
) -> DataFrame:
    """candidates(category, target) -> the planned number per set and category, no target twice.

    plan holds (set, category, n); categories choose in the given order (scarce ones first), the
    test set before the dev set, each in hash order from what no earlier choice used. A choice is
    as small as its plan, so the used targets stay small.
    """
    chosen: list[DataFrame] = []
    for category in order:
        pool = candidates.where(F.col("category") == category).select("target").distinct()
        for one in chosen:
            pool = pool.join(one.select("target"), "target", "left_anti")
        wanted = [(s, n) for s, c, n in plan if c == category]
        total = sum(n for _, n in wanted)
        taken = pool.withColumn("_h", hash_order(f"{seed}:{category}", "target")).orderBy(
            "_h", "target"
        ).limit(total)
        # At most `total` planned rows are numbered in one task.
        numbered = taken.withColumn("place", F.row_number().over(Window.orderBy("_h", "target")))
        label, start = F.lit(None).cast("string"), 0
        for set_name, n in wanted:
            label = F.when(F.col("place").between(start + 1, start + n), set_name).otherwise(label)
            start += n
        chosen.append(
            stage(numbered.select(label.alias("set"), F.lit(category).alias("category"), "target"),
                  "allocated")
        )
    return reduce(DataFrame.union, chosen)


def shared_targets(first: DataFrame, second: DataFrame) -> DataFrame:
    """Targets two sets have in common; must be empty."""
    return first.select("target").intersect(second.select("target"))


def review_sample(items: DataFrame, per_category: int = 3) -> DataFrame:
    """Per category the first item of each subtype, then the rest, in ID order, up to three."""
    firsts = items.groupBy("category", "subtype").agg(F.min("item_id").alias("first_id"))
    marked = items.join(firsts, ["category", "subtype"])
    order = Window.partitionBy("category").orderBy(
        F.when(F.col("item_id") == F.col("first_id"), 0).otherwise(1), "item_id"
    )
    return marked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_category)


def validate_retrieval_set(
    catalog: Catalog, items: DataFrame, unique: DataFrame, per_type: int, frame: list[str]
) -> DataFrame:
    """Violations of a retrieval set: items(item_id, type, query, target_id)."""
    types = items.groupBy("type").agg(F.count("*").alias("n"))
    twice = items.groupBy("query").agg(F.count("*").alias("n"), F.min("item_id").alias("item_id"))
    reports = catalog.reports.select(
        F.col("report_id").alias("target_id"), "name", "status",
        F.concat_ws(" ", "description", "tags").alias("target_text"),
    )
    p = items.where("type = 'P'").join(reports, "target_id")
    alone = unique.select(F.col("report_id").alias("target_id"))
    d = items.where("type = 'D'").join(reports, "target_id")
    overlap = content_overlap(F.col("query"), F.col("target_text"), words_array(frame))
    return summarize(
        [
            broken(types.where(F.col("n") != per_type), "count_per_type", "type"),
            broken(twice.where("n > 1"), "duplicate_query", "item_id"),
            broken(p.where(name_overlap(F.col("query"), F.col("name")) > MAX_NAME_OVERLAP),
                   "name_overlap", "item_id"),
            broken(p.where(overlap > MAX_TEXT_OVERLAP), "description_overlap", "item_id"),
            broken(p.join(alone, "target_id", "left_anti"), "shared_topic", "item_id"),
            broken(d.where("status <> 'active'"), "target_active", "item_id"),
        ],
        ["count_per_type", "duplicate_query", "name_overlap", "description_overlap", "shared_topic",
         "target_active"],
    )


def validate_question_set(items: DataFrame, plan: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Violations of a question set against its plan(category, n) and recomputed gold(item_id,
    gold_ids): counts, duplicates, gold, rule, leaks, abstain flags and empty answers."""
    counts = items.groupBy("category").agg(F.count("*").alias("made"))
    off_plan = plan.join(counts, "category", "full").where("NOT (n <=> made)")
    twice = [
        broken(
            items.groupBy(column).agg(F.count("*").alias("n")).where("n > 1"), f"duplicate_{column}", column
        )
        for column in ("item_id", "question")
    ]
    again = recomputed.select("item_id", F.array_sort("gold_ids").alias("fresh"))
    stale = items.join(again, "item_id").where(~F.array_sort("gold_ids").eqNullSafe(F.col("fresh")))
    rule = scoring_rule(F.col("category"), F.col("subtype"), F.size("gold_ids"))
    leaks = F.exists("gold_ids", lambda g: F.contains(F.col("question"), g))
    unanswerable = F.col("category") == "L6"
    return summarize(
        [
            broken(off_plan, "count_per_category", "category"),
            *twice,
            broken(stale, "gold_matches_spec", "item_id"),
            broken(items.where(F.col("scoring") != rule), "scoring_rule", "item_id"),
            broken(items.where(leaks), "id_in_question", "item_id"),
            broken(items.where(unanswerable & ~F.col("should_abstain")), "must_abstain", "item_id"),
            broken(items.where(~unanswerable & (F.size("gold_ids") == 0)), "empty_gold", "item_id"),
        ],
        ["count_per_category", "duplicate_item_id", "duplicate_question", "gold_matches_spec",
         "scoring_rule", "id_in_question", "must_abstain", "empty_gold"],
    )


def set_notes(items: DataFrame) -> DataFrame:
    """Depths of lineage questions and sizes of broadcast answers, counted."""
    depths = items.where("gold_type IN ('upstream_tables', 'downstream_reports')").select(
        F.lit("depth").alias("note"), F.col("depth").cast("bigint").alias("value")
    )
    sizes = items.where("gold_type = 'impact_notify' AND subtype = 'broadcast'").select(
        F.lit("broadcast size").alias("note"), F.size("gold_ids").cast("bigint").alias("value")
    )
    return depths.union(sizes).groupBy("note", "value").agg(F.count("*").alias("n"))
