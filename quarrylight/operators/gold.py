"""Gold answers in long form, scores of answer sets, and answers that need no model.

Gold is (item keys, record_id, forbidden): sets of any size stay rows and are never gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.config import F1_THRESHOLD, NOTIFY_DETAIL_MAX
from quarrylight.operators import lineage
from quarrylight.operators.impact import department_counts, notify_ranked, told_counts
from quarrylight.operators.ownership import contacts, department_heads
from quarrylight.sources.catalog import Catalog, assets


def described_assets(catalog: Catalog, specs: DataFrame) -> DataFrame:
    """specs(item_id, target_id, forbidden_ids) -> gold rows; unknown IDs are error rows."""
    rows = specs.select("item_id", F.col("target_id").alias("record_id"),
                        F.lit(False).alias("forbidden")).union(
        specs.select("item_id", F.explode("forbidden_ids"), F.lit(True))
    )
    known = assets(catalog).select(F.col("asset_id").alias("record_id"), F.lit(True).alias("known"))
    return rows.join(known, "record_id", "left").select(
        "item_id", "record_id", "forbidden",
        F.when(F.col("known").isNull(), "unknown asset").alias("error"),
    )


def current_contacts(catalog: Catalog, specs: DataFrame) -> DataFrame:
    """specs(item_id, asset_id), one row per asset -> contacts, and departed owners forbidden
    unless they are a contact of the item too."""
    owners = assets(catalog).select("asset_id", "owner_id")
    people = contacts(catalog).select(
        F.col("employee_id").alias("owner_id"), "contact_id", "status"
    )
    walked = specs.join(owners, "asset_id").join(people, "owner_id")
    answers = walked.select("item_id", F.col("contact_id").alias("record_id")).distinct()
    departed = walked.where("status = 'left'").select(
        "item_id", F.col("owner_id").alias("record_id")
    ).distinct().join(answers, ["item_id", "record_id"], "left_anti")
    return answers.withColumn("forbidden", F.lit(False)).union(
        departed.withColumn("forbidden", F.lit(True))
    )


def similar_requests(specs: DataFrame, topics: DataFrame) -> DataFrame:
    """specs(item_id, topic_key), topics(request_id, topic_key) -> all requests of the topic; a
    topic without requests is an error row."""
    return specs.join(topics, "topic_key", "left").select(
        "item_id", F.col("request_id").alias("record_id"), F.lit(False).alias("forbidden"),
        F.when(F.col("request_id").isNull(), "no requests for topic").alias("error"),
    )


def impact_notify(catalog: Catalog) -> DataFrame:
    """(table_id, record_id, forbidden, min_mentioned_count) for every table somebody is told of.

    Up to twenty people are the answer themselves; above that the heads of their departments
    are, the other heads are forbidden, and the number of people should be mentioned.
    """
    listed = notify_ranked(catalog, NOTIFY_DETAIL_MAX).select("table_id", "employee_id")
    sizes = told_counts(catalog)
    few = listed.join(sizes.where(F.col("people") <= NOTIFY_DETAIL_MAX), "table_id").select(
        "table_id", F.col("employee_id").alias("record_id"), F.lit(False).alias("forbidden"),
        F.lit(None).cast("bigint").alias("min_mentioned_count"),
    )
    reached = department_counts(catalog).select("table_id", "department").join(
        sizes.where(F.col("people") > NOTIFY_DETAIL_MAX), "table_id"
    )
    # The heads are one row per department; together they are one short array.
    heads = department_heads(catalog)
    every = heads.agg(F.collect_list(F.struct("department", "head_id"))).scalar()
    wide = reached.groupBy("table_id").agg(
        F.collect_set("department").alias("departments"), F.max("people").alias("people")
    ).withColumn("head", F.explode(every))
    many = wide.select(
        "table_id", F.col("head.head_id").alias("record_id"),
        (~F.array_contains("departments", F.col("head.department"))).alias("forbidden"),
        F.col("people").alias("min_mentioned_count"),
    )
    return few.union(many)


def chain_last_step(specs: DataFrame) -> DataFrame:
    """specs(item_id, steps ARRAY<STRUCT<type, id, depth>>) -> the step that decides the answer."""
    return specs.select("item_id", F.element_at("steps", -1).alias("s")).select("item_id", "s.*")


def chain_gold(catalog: Catalog, specs: DataFrame, topics: DataFrame) -> DataFrame:
    """Gold of chained questions: that of their last step, one branch per step type."""
    last = chain_last_step(specs).withColumnRenamed("id", "step_id")
    contact = current_contacts(
        catalog,
        last.where("type = 'current_contact_for_asset'").select(
            "item_id", F.col("step_id").alias("asset_id")
        ),
    )
    topic = similar_requests(
        last.where("type = 'similar_requests'").select("item_id", F.col("step_id").alias("topic_key")),
        topics,
    ).where("error IS NULL").select("item_id", "record_id", "forbidden")
    asked = last.where("type = 'upstream_tables'").select(
        "item_id", F.col("step_id").alias("seed"), "depth"
    )
    found = lineage.upstream_tables(catalog, asked).select("seed", "depth", "node")
    upstream = asked.join(found, ["seed", "depth"]).select(
        "item_id", F.col("node").alias("record_id"), F.lit(False).alias("forbidden")
    )
    return contact.union(topic).union(upstream)


def score_sets(
    gold: DataFrame, given: DataFrame, rules: DataFrame, key: str = "item_id"
) -> DataFrame:
    """Scores of answers kept as rows, any size.

    gold(key, record_id, forbidden), given(key, record_id), rules(key, scoring, abstained): one
    row per answered question. One shuffle on the key's records counts what the rules need.
    """
    wanted = gold.select(
        key, "record_id", F.when(F.col("forbidden"), 0).otherwise(1).alias("w"),
        F.when(F.col("forbidden"), 1).otherwise(0).alias("f"), F.lit(0).alias("g"),
    )
    said = given.select(key, "record_id", F.lit(0).alias("w"), F.lit(0).alias("f"), F.lit(1).alias("g"))
    merged = wanted.union(said).groupBy(key, "record_id").agg(
        F.max("w").alias("w"), F.max("f").alias("f"), F.max("g").alias("g")
    )
    counts = merged.groupBy(key).agg(
        F.sum("w").alias("n_gold"), F.sum("g").alias("n_given"),
        F.sum(F.col("w") * F.col("g")).alias("hits"),
        F.sum(F.col("f") * F.col("g")).alias("forbidden_given"),
        F.sum(F.col("g") * F.col("record_id").startswith("EMP-").cast("int")).alias("people_given"),
    )
    joined = rules.join(counts, key, "left").fillna(
        0, ["n_gold", "n_given", "hits", "forbidden_given", "people_given"]
    )
    rule = F.col("scoring")
    f1 = F.when(
        F.col("n_gold") + F.col("n_given") > 0,
        F.lit(2) * F.col("hits") / (F.col("n_gold") + F.col("n_given")),
    ).otherwise(F.lit(0.0))
    answered = ~F.col("abstained")
    correct = (
        F.when(rule == "contains_all",
               answered & (F.col("hits") == F.col("n_gold")) & (F.col("forbidden_given") == 0))
        .when(rule == "contains_any", answered & (F.col("hits") > 0))
        .when(rule == "set_f1", answered & (f1 >= F1_THRESHOLD))
        .when(rule == "abstain", F.col("abstained") & (F.col("people_given") == 0))
    )
    return joined.withColumn("f1", f1).withColumn("correct", correct)


# ---------------------------------------------------------------- baselines


def recorded_owner_baseline(catalog: Catalog) -> DataFrame:
    """Answering with the owner on record: correct when the owner is the contact."""
    people = contacts(catalog).select(F.col("employee_id").alias("owner_id"), "contact_id")
    return assets(catalog).select("asset_id", "owner_id").join(people, "owner_id").select(
        F.col("asset_id").alias("item_id"), (F.col("owner_id") == F.col("contact_id")).alias("correct")
    )


def all_heads_baseline(catalog: Catalog) -> DataFrame:
    """Naming every head on broadcast questions: correct when no head is forbidden."""
    return impact_notify(catalog).where("min_mentioned_count IS NOT NULL").groupBy("table_id").agg(
        (~F.bool_or("forbidden")).alias("correct")
    ).withColumnRenamed("table_id", "item_id")


def default_depth_baseline(catalog: Catalog, requests: DataFrame, depth: int = 3) -> DataFrame:
    """Lineage at a fixed depth whatever was asked: requests(seed, depth) -> correct by F1.

    Each seed is walked once, to the larger of both depths; distances tell the two sets apart. The
    walk goes as deep as the largest depth asked, which is read first.
    """
    steps = lineage.directed_edges(catalog, "upstream")
    asked = requests.select("seed", F.col("depth").alias("asked")).distinct()
    seeds = asked.groupBy("seed").agg(F.greatest(F.max("asked"), F.lit(depth)).alias("depth"))
    hops = seeds.agg(F.max("depth")).first()[0] or depth
    found = lineage.reach(steps, seeds, hops).where("node LIKE 'TBL-%'")
    met = found.join(asked, "seed")
    counts = met.groupBy("seed", "asked").agg(
        F.count_if(F.col("distance") <= F.col("asked")).alias("n_gold"),
        F.count_if(F.col("distance") <= depth).alias("n_given"),
        F.count_if(F.col("distance") <= F.least("asked", F.lit(depth))).alias("hits"),
    )
    f1 = F.lit(2) * F.col("hits") / (F.col("n_gold") + F.col("n_given"))
    single = F.col("n_gold") == 1
    correct = F.when(single, F.col("hits") == 1).otherwise(f1 >= F1_THRESHOLD)
    return counts.select(
        F.col("seed").alias("item_id"), F.col("asked").alias("depth"), "n_gold", "n_given",
        correct.alias("correct"),
    )


def abstain_baseline(items: DataFrame) -> DataFrame:
    """Abstaining on everything: correct where the question has no answer."""
    return items.select("item_id", "category", F.col("should_abstain").alias("correct"))


def top_hit_baseline(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """Answering with the first hit: targets(query_id, record_id) lists the right ones."""
    first = hits.where(F.col("rank") == 1).select("query_id", F.col("doc_id").alias("record_id"))
    right = first.join(targets, ["query_id", "record_id"], "left_semi").select(
        "query_id", F.lit(True).alias("hit")
    ).distinct()
    asked = targets.select("query_id").distinct()
    return asked.join(right, "query_id", "left").select(
        F.col("query_id").alias("item_id"), F.coalesce("hit", F.lit(False)).alias("correct")
    )


def baseline_accuracy(scored: dict[tuple[str, str], DataFrame]) -> DataFrame:
    """(baseline, category) -> n and accuracy, from tables with a `correct` column."""
    parts = [
        df.select(F.lit(name).alias("baseline"), F.lit(category).alias("category"), "correct")
        for (name, category), df in scored.items()
    ]
    return reduce(DataFrame.union, parts).groupBy("baseline", "category").agg(
        F.count("*").alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy")
    )
