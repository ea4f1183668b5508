"""Data-quality rules over the catalog: every rule is a table of violating records.

A family of rules returns (rule, violations, sample, value): how many records break a rule, the
lowest of them, and for share rules the measured share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.scalars import json_columns, packed_list
from quarrylight.functions.text import ascii_words, jaccard, sentence_count, word_set
from quarrylight.operators.lineage import reach
from quarrylight.operators.ownership import contacts
from quarrylight.schemas import RECORD_PREFIXES, TABLE_NAME
from quarrylight.sources.catalog import Catalog, metric_sources

KEYS = {
    "employees": ("employee_id", "employee"),
    "reports": ("report_id", "report"),
    "tables": ("table_id", "table"),
    "metrics": ("metric_id", "metric"),
    "requests": ("request_id", "request"),
}


def broken(df: DataFrame, rule: str, record: str | Column) -> DataFrame:
    """The records of df as violations of a rule."""
    column = F.col(record) if isinstance(record, str) else record
    return df.select(F.lit(rule).alias("rule"), column.cast("string").alias("record"))


def summarize(parts: list[DataFrame], rules: list[str]) -> DataFrame:
    """rule, violations, sample, value; rules nothing breaks are reported with 0."""
    found = reduce(DataFrame.union, parts).groupBy("rule").agg(
        F.count("*").alias("violations"), F.min("record").alias("sample")
    )
    spark = found.sparkSession
    every = spark.createDataFrame([(r,) for r in rules], "rule string")
    return every.join(found, "rule", "left").select(
        "rule", F.coalesce("violations", F.lit(0)).alias("violations"), "sample",
        F.lit(None).cast("double").alias("value"),
    )


def share(df: DataFrame, rule: str, test: Column, low: float, high: float) -> DataFrame:
    """One row: the share of df that passes the test, a violation when outside [low, high]."""
    measured = df.agg(F.avg(test.cast("int")).alias("value"))
    return measured.select(
        F.lit(rule).alias("rule"),
        F.when(F.col("value").between(low, high), 0).otherwise(1).cast("bigint").alias("violations"),
        F.lit(None).cast("string").alias("sample"), "value",
    )


def id_number(column: str) -> Column:
    return F.split(F.col(column), "-")[1].cast("bigint")


def primary_keys(catalog: Catalog) -> DataFrame:
    """Unique, well-formed IDs in five tables and unique pairs in the two edge tables."""
    parts, rules = [], []
    for table, (key, kind) in KEYS.items():
        df = getattr(catalog, table)
        rules += [f"{table}.unique", f"{table}.format"]
        twice = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
        parts.append(broken(twice, f"{table}.unique", key))
        shape = f"^{RECORD_PREFIXES[kind]}-[0-9]{{3,}}$"
        parts.append(broken(df.where(~F.col(key).rlike(shape)), f"{table}.format", key))
    for table, (a, b) in {
        "report_table_edges": ("report_id", "table_id"),
        "table_table_edges": ("parent_table_id", "child_table_id"),
    }.items():
        rules.append(f"{table}.unique")
        twice = getattr(catalog, table).groupBy(a, b).agg(F.count("*").alias("n")).where("n > 1")
        parts.append(broken(twice, f"{table}.unique", F.concat_ws(" ", a, b)))
    return summarize(parts, rules)


def dense_sequences(catalog: Catalog, first: int = 1) -> DataFrame:
    """Per table: the numbers of its IDs are exactly first .. first + n - 1."""
    parts = []
    for table, (key, _) in KEYS.items():
        parts.append(
            getattr(catalog, table).select(id_number(key).alias("number")).agg(
                F.lit(table).alias("table_name"), F.min("number").alias("low"),
                F.max("number").alias("high"), F.count("*").alias("n"),
                F.count_distinct("number").alias("different"),
            )
        )
    found = reduce(DataFrame.union, parts)
    dense = (
        (F.col("low") == first) & (F.col("high") == F.col("n") + first - 1)
        & (F.col("different") == F.col("n"))
    )
    return found.select("table_name", "low", "high", "n", dense.alias("is_dense"))


REFERENCES = [
    ("employees", "manager_id", "employees"), ("employees", "successor_id", "employees"),
    ("reports", "owner_id", "employees"), ("reports", "replaced_by_report_id", "reports"),
    ("tables", "owner_id", "employees"), ("metrics", "owner_id", "employees"),
    ("requests", "requester_id", "employees"), ("requests", "assignee_id", "employees"),
    ("requests", "resulting_report_id", "reports"),
    ("requests", "duplicate_of_request_id", "requests"),
    ("report_table_edges", "report_id", "reports"), ("report_table_edges", "table_id", "tables"),
    ("table_table_edges", "parent_table_id", "tables"),
    ("table_table_edges", "child_table_id", "tables"),
]


def foreign_keys(catalog: Catalog) -> DataFrame:
    """Fifteen references, one of them inside a JSON array; NULL refers to nothing.

    References to the same table are checked by one anti join over their distinct values.
    """
    parts = []
    for target in ("employees", "reports", "tables", "requests"):
        key = KEYS[target][0]
        pointing = [
            broken(getattr(catalog, t).where(F.col(c).isNotNull()), f"{t}.{c}", c)
            for t, c, to in REFERENCES if to == target
        ]
        if target == "tables":
            pointing.append(broken(metric_sources(catalog), "metrics.source_table_ids", "table_id"))
        values = reduce(DataFrame.union, pointing).distinct()
        known = getattr(catalog, target).select(F.col(key).alias("record"))
        parts.append(values.join(known, "record", "left_anti").select("rule", "record"))
    rules = [f"{t}.{c}" for t, c, _ in REFERENCES] + ["metrics.source_table_ids"]
    return summarize(parts, rules)


def manager_tree(catalog: Catalog) -> DataFrame:
    """One root, everybody below it, and active managers for people who left."""
    people = catalog.employees
    roots = people.where("manager_id IS NULL").select("employee_id")
    first = roots.agg(F.min("employee_id")).scalar()
    down = people.where("manager_id IS NOT NULL").select(
        F.col("manager_id").alias("src"), F.col("employee_id").alias("dst")
    )
    top = roots.where(F.col("employee_id") == first)
    below = reach(down, top.select(F.col("employee_id").alias("seed"))).select(
        F.col("node").alias("employee_id")
    )
    unreached = people.select("employee_id").join(below.union(top), "employee_id", "left_anti")
    managers = people.select(F.col("employee_id").alias("manager_id"),
                             F.col("status").alias("manager_status"))
    gone = people.where("status = 'left'").join(managers, "manager_id", "left")
    return summarize(
        [
            broken(roots.where(F.col("employee_id") != first), "single_root", "employee_id"),
            broken(unreached, "connected", "employee_id"),
            broken(gone.where("coalesce(manager_status, '') <> 'active'"), "manager_active",
                   "employee_id"),
        ],
        ["single_root", "connected", "manager_active"],
    )


def status_dates(catalog: Catalog, days: int = 60) -> DataFrame:
    """Leaving dates go with the status; a successor starts within `days` of the leaving."""
    people = catalog.employees
    left = F.col("status") == "left"
    wrong_dates = people.where(
        (left & (F.col("left_date").isNull() | (F.col("left_date") <= F.col("start_date"))))
        | (~left & F.col("left_date").isNotNull())
    )
    wrong_successor = people.where(
        (~left & F.col("successor_id").isNotNull())
        | (F.col("successor_id") == F.col("employee_id"))
    )
    starts = people.select(F.col("employee_id").alias("successor_id"),
                           F.col("start_date").alias("successor_start"))
    late = people.join(starts, "successor_id").where(
        F.col("successor_start") > F.date_add("left_date", days)
    )
    return summarize(
        [
            broken(wrong_dates, "dates_match_status", "employee_id"),
            broken(wrong_successor, "successor_only_for_leavers", "employee_id"),
            broken(late, "successor_starts_in_time", "employee_id"),
        ],
        ["dates_match_status", "successor_only_for_leavers", "successor_starts_in_time"],
    )


def structures(catalog: Catalog, chains: DataFrame) -> DataFrame:
    """chains(code, chain ARRAY) of departed people: linked by successors, walks as long as the
    code says, every leaver in exactly one chain.

    Codes: C followed by the length of the chain. A chain of up to three resolves in as many
    hops; a longer one stops at three.
    """
    members = chains.select(
        "code", F.posexplode("chain").alias("pos", "employee_id"), "chain",
        F.size("chain").alias("length"),
    )
    people = catalog.employees.select("employee_id", "status", "successor_id")
    known = members.join(people, "employee_id", "left")
    following = F.try_element_at("chain", F.col("pos") + 2)
    unlinked = known.where(
        (F.col("pos") < F.col("length") - 1) & ~F.col("successor_id").eqNullSafe(following)
    )
    walks = contacts(catalog).select("employee_id", "resolved", F.col("hops").alias("walked"))
    heads = members.where("pos = 0").join(walks, "employee_id")
    expected = F.least(F.col("length"), F.lit(3))
    wrong = heads.where(
        (F.col("walked") != expected) | (F.col("resolved") != (F.col("length") <= 3))
    )
    times = members.groupBy("employee_id").agg(F.count("*").alias("n"))
    leavers = people.where("status = 'left'").select("employee_id")
    outside = leavers.join(members.select("employee_id"), "employee_id", "left_anti")
    return summarize(
        [
            broken(known.where("coalesce(status, '') <> 'left'"), "members_left", "employee_id"),
            broken(unlinked, "linked", "employee_id"),
            broken(wrong, "walk_matches_length", "employee_id"),
            broken(times.where("n > 1"), "one_chain_each", "employee_id"),
            broken(outside, "leavers_covered", "employee_id"),
        ],
        ["members_left", "linked", "walk_matches_length", "one_chain_each", "leavers_covered"],
    )


def one_head(catalog: Catalog) -> DataFrame:
    """Exactly one active head per department, and heads report to the root."""
    people = catalog.employees
    heads = people.where("is_department_head")
    per = people.groupBy("department").agg(F.count_if("is_department_head").alias("heads"))
    first = people.where("manager_id IS NULL").agg(F.min("employee_id")).scalar()
    astray = heads.where(
        (F.col("employee_id") != first) & ~F.col("manager_id").eqNullSafe(first)
    )
    return summarize(
        [
            broken(per.where("heads <> 1"), "one_head", "department"),
            broken(heads.where("status <> 'active'"), "head_active", "employee_id"),
            broken(astray, "head_reports_to_root", "employee_id"),
        ],
        ["one_head", "head_active", "head_reports_to_root"],
    )


def min_owned(catalog: Catalog, starters: DataFrame) -> DataFrame:
    """starters(employee_id, minimum) own at least that many active reports."""
    owned = catalog.reports.where("status = 'active'").groupBy(
        F.col("owner_id").alias("employee_id")
    ).agg(F.count("*").alias("owned"))
    few = starters.join(owned, "employee_id", "left").where(
        F.coalesce("owned", F.lit(0)) < F.col("minimum")
    )
    return summarize([broken(few, "owns_enough", "employee_id")], ["owns_enough"])


PREFIXES = {"staging": "^stg_", "intermediate": "^int_", "mart": "^(fct|dim)_"}


def edge_layers(catalog: Catalog) -> DataFrame:
    """Table edges with the layers of both ends."""
    layers = catalog.tables.select("table_id", "layer")
    parents = layers.select(F.col("table_id").alias("parent_table_id"),
                            F.col("layer").alias("parent_layer"))
    children = layers.select(F.col("table_id").alias("child_table_id"),
                             F.col("layer").alias("child_layer"))
    return catalog.table_table_edges.join(parents, "parent_table_id").join(
        children, "child_table_id"
    )


def layers(catalog: Catalog, required: list[str]) -> DataFrame:
    """Name prefixes per layer, unique names, allowed edge directions, required marts, skips."""
    tables = catalog.tables
    prefix_ok = F.lit(False)
    for layer, pattern in PREFIXES.items():
        prefix_ok = prefix_ok | ((F.col("layer") == layer) & F.col("name").rlike(pattern))
    edges = edge_layers(catalog)
    pair = F.concat_ws(">", "parent_layer", "child_layer")
    allowed = pair.isin("staging>intermediate", "intermediate>mart", "staging>mart") | (
        (pair == "intermediate>intermediate")
        & (F.col("parent_table_id") < F.col("child_table_id"))
    )
    wanted = tables.sparkSession.createDataFrame([(n,) for n in required], "name string")
    marts = tables.where("layer = 'mart'").select("name")
    twice = tables.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    rows = summarize(
        [
            broken(tables.where(~F.col("name").rlike(TABLE_NAME)), "name_shape", "table_id"),
            broken(tables.where(~prefix_ok), "prefix_matches_layer", "table_id"),
            broken(twice, "names_unique", "name"),
            broken(edges.where(~allowed), "edge_direction",
                   F.concat_ws(" ", "parent_table_id", "child_table_id")),
            broken(wanted.join(marts, "name", "left_anti"), "required_marts", "name"),
        ],
        ["name_shape", "prefix_matches_layer", "names_unique", "edge_direction", "required_marts"],
    )
    return rows.union(share(edges, "skip_share", pair == "staging>mart", 0.0, 0.10))


def cardinality(catalog: Catalog, most: int = 5) -> DataFrame:
    """Reports read 1 to `most` tables, none of staging, mostly marts; lineage has no loose ends."""
    links = catalog.report_table_edges
    counts = catalog.reports.select("report_id").join(
        links.groupBy("report_id").agg(F.count("*").alias("n")), "report_id", "left"
    )
    layered = links.join(catalog.tables.select("table_id", "layer"), "table_id")
    edges = catalog.table_table_edges
    later = catalog.tables.where("layer <> 'staging'").select("table_id")
    orphans = later.join(
        edges.select(F.col("child_table_id").alias("table_id")), "table_id", "left_anti"
    )
    used = edges.select(F.col("parent_table_id").alias("table_id")).distinct().withColumn(
        "used", F.lit(True)
    )
    staging = catalog.tables.where("layer = 'staging'").join(used, "table_id", "left")
    rows = summarize(
        [
            broken(counts.where(f"coalesce(n, 0) NOT BETWEEN 1 AND {most}"), "tables_per_report",
                   "report_id"),
            broken(layered.where("layer = 'staging'"), "no_staging",
                   F.concat_ws(" ", "report_id", "table_id")),
            broken(orphans, "has_parent", "table_id"),
        ],
        ["tables_per_report", "no_staging", "has_parent"],
    )
    marts = share(layered, "mart_share", F.col("layer") == "mart", 0.90, 1.0)
    children = share(staging, "staging_used_share", F.coalesce("used", F.lit(False)), 0.90, 1.0)
    return rows.union(marts).union(children)


def metric_rules(catalog: Catalog, most: int = 3) -> DataFrame:
    """1 to `most` mart sources, at least one alias; metrics without a formula are counted."""
    counted = catalog.metrics.withColumn(
        "n", F.coalesce(F.size(F.from_json("source_table_ids", "array<string>")), F.lit(0))
    )
    sources = metric_sources(catalog).join(catalog.tables.select("table_id", "layer"), "table_id")
    return summarize(
        [
            broken(counted.where(f"n NOT BETWEEN 1 AND {most}"), "source_count", "metric_id"),
            broken(sources.where("layer <> 'mart'"), "mart_sources",
                   F.concat_ws(" ", "metric_id", "table_id")),
            broken(counted.where(F.size(packed_list(F.col("aliases"))) == 0), "has_alias",
                   "metric_id"),
            broken(counted.where("formula IS NULL"), "no_formula", "metric_id"),
        ],
        ["source_count", "mart_sources", "has_alias", "no_formula"],
    )


def tenure(df: DataFrame, people: DataFrame, person: str, day: str) -> DataFrame:
    """Rows of df whose day lies outside the employment of the person."""
    employed = people.select(
        F.col("employee_id").alias(person), F.col("start_date").alias("_start"),
        F.col("left_date").alias("_left"), (F.col("status") == "left").alias("_gone"),
    )
    outside = (F.col(day) < F.col("_start")) | (F.col("_gone") & (F.col(day) >= F.col("_left")))
    return df.join(employed, person).where(outside)


#: Blocks whose ends meet in one task of `_carried`.
FAN_IN = 65_536


def _carried(ends: DataFrame, level: int) -> DataFrame:
    """ends(_block, _end_day): for every block the end of the block before it that has one.

    A tree: neighbours are compared inside groups of FAN_IN blocks, and only the last end of a
    group goes up a level, so no task sees more than FAN_IN rows.
    """
    grouped = ends.withColumn("_group", F.expr(f"_block div {FAN_IN}"))
    inside = Window.partitionBy("_group").orderBy("_block")
    lagged = grouped.withColumn("_near", F.lag("_end_day").over(inside))
    if level == 1:
        return lagged.select("_block", F.col("_near").alias("_carry"))
    tops = grouped.groupBy(F.col("_group").alias("_block")).agg(
        F.max_by("_end_day", "_block").alias("_end_day")
    )
    above = _carried(tops, level - 1).withColumnsRenamed({"_block": "_group", "_carry": "_far"})
    first = F.row_number().over(inside) == 1
    return lagged.withColumn("_first", first).join(above, "_group").select(
        "_block", F.when(F.col("_first"), F.col("_far")).otherwise(F.col("_near")).alias("_carry")
    )


def out_of_order(df: DataFrame, key: str, day: str, block: int = 100_000) -> DataFrame:
    """Records whose day is before the day of the record with the next lower ID.

    Records are compared inside blocks of the ID's number; only the last record of each block is
    carried over to the next one, up and down a tree of blocks as high as 64-bit numbers need.
    """
    levels = 1
    while 2**63 // block // FAN_IN**levels:
        levels += 1
    numbered = df.select(
        F.col(key).alias("record"), id_number(key).alias("_number"), F.col(day).alias("_day")
    ).withColumn("_block", F.expr(f"_number div {block}"))
    inside = Window.partitionBy("_block").orderBy("_number")
    lagged = numbered.withColumn("_before", F.lag("_day").over(inside))
    ends = numbered.where("_block IS NOT NULL").groupBy("_block").agg(
        F.max_by("_day", "_number").alias("_end_day")
    )
    joined = lagged.join(_carried(ends, levels), "_block")
    return joined.where(F.col("_day") < F.coalesce("_before", "_carry")).select("record")


def temporal(catalog: Catalog, today: str) -> DataFrame:
    """Dates of reports and requests against owners, each other and the reference day."""
    reports, requests = catalog.reports, catalog.requests
    end = F.to_date(F.lit(today))
    refresh = reports.where(
        (F.col("last_refresh") < F.col("created_date")) | (F.col("last_refresh") > end)
    )
    is_open = F.col("status").isin("open", "in_progress")
    closing = requests.where(
        (is_open & F.col("closed_date").isNotNull())
        | (~is_open & (F.col("closed_date").isNull()
                       | (F.col("closed_date") < F.col("created_date"))
                       | (F.col("closed_date") > end)))
    )
    made = reports.select(F.col("report_id").alias("resulting_report_id"),
                          F.col("created_date").alias("made"))
    early = requests.join(made, "resulting_report_id").where(F.col("made") < F.col("created_date"))
    return summarize(
        [
            broken(tenure(reports, catalog.employees, "owner_id", "created_date"),
                   "owner_employed", "report_id"),
            broken(refresh, "refresh_after_creation", "report_id"),
            broken(closing, "closing_matches_status", "request_id"),
            broken(early, "result_after_request", "request_id"),
            broken(out_of_order(requests, "request_id", "created_date"), "ids_in_creation_order",
                   "record"),
        ],
        ["owner_employed", "refresh_after_creation", "closing_matches_status",
         "result_after_request", "ids_in_creation_order"],
    )


def replacements(catalog: Catalog) -> DataFrame:
    """Deprecated reports point to an active report that shares a table; others to none."""
    reports = catalog.reports
    points = F.col("replaced_by_report_id").isNotNull()
    deprecated = F.col("status") == "deprecated"
    pairs = reports.where(points).select("report_id", "replaced_by_report_id")
    target = reports.select(
        F.col("report_id").alias("replaced_by_report_id"), F.col("status").alias("t_status"),
        F.col("replaced_by_report_id").alias("t_next"),
    )
    met = pairs.join(target, "replaced_by_report_id")
    links = catalog.report_table_edges
    mine = pairs.join(links, "report_id")
    theirs = links.select(F.col("report_id").alias("replaced_by_report_id"), "table_id")
    sharing = mine.join(theirs, ["replaced_by_report_id", "table_id"], "left_semi").select("report_id")
    return summarize(
        [
            broken(reports.where(points != deprecated), "replaced_iff_deprecated", "report_id"),
            broken(met.where("t_status <> 'active' OR t_next IS NOT NULL"), "replacement_active",
                   "report_id"),
            broken(pairs.join(sharing, "report_id", "left_anti"), "shares_a_table", "report_id"),
            broken(reports.where(deprecated & (F.col("refresh_status") != "disabled")),
                   "refresh_disabled", "report_id"),
        ],
        ["replaced_iff_deprecated", "replacement_active", "shares_a_table", "refresh_disabled"],
    )


def pair_similarity(catalog: Catalog, pairs: DataFrame) -> DataFrame:
    """pairs(a, b) of reports with both names and their Jaccard similarity."""
    names = catalog.reports.select("report_id", "name")
    left = names.select(F.col("report_id").alias("a"), F.col("name").alias("name_a"))
    right = names.select(F.col("report_id").alias("b"), F.col("name").alias("name_b"))
    similarity = jaccard(
        F.array_distinct(ascii_words(F.col("name_a"))), F.array_distinct(ascii_words(F.col("name_b")))
    )
    return pairs.join(left, "a").join(right, "b").withColumn("similarity", similarity)


def near_duplicates(catalog: Catalog, pairs: DataFrame, traits: DataFrame) -> DataFrame:
    """Designed pairs: disjoint, similar (at least 0.5) but not equal names; a regional variant
    of a report whose subject also has a by-region report is a clash.

    traits(report_id, subject, qualifier, variant).
    """
    members = pairs.select(F.explode(F.array("a", "b")).alias("report_id"))
    twice = members.groupBy("report_id").agg(F.count("*").alias("n")).where("n > 1")
    similar = pair_similarity(catalog, pairs)
    region = traits.where("qualifier = 'region'").select("subject").distinct()
    clash = traits.where("variant IN ('regional', 'area_managers')").join(
        region, "subject", "left_semi"
    )
    pair = F.concat_ws(" ", "a", "b")
    return summarize(
        [
            broken(twice, "pairs_disjoint", "report_id"),
            broken(similar.where("similarity < 0.5"), "similar_enough", pair),
            broken(similar.where("name_a = name_b"), "names_differ", pair),
            broken(clash, "no_region_clash", "report_id"),
        ],
        ["pairs_disjoint", "similar_enough", "names_differ", "no_region_clash"],
    )


# Expected shares of request states.
STATUS_SHARES = {
    "done": 0.55, "duplicate": 0.13, "open": 0.12, "rejected": 0.10, "in_progress": 0.10,
}


def status_mix(catalog: Catalog, topics: DataFrame) -> DataFrame:
    """Request states near their shares; duplicates point to an earlier request of the topic.

    topics(request_id, topic_key).
    """
    requests = catalog.requests
    points = F.col("duplicate_of_request_id").isNotNull()
    topic = topics.select("request_id", F.col("topic_key").alias("topic"))
    mine = requests.where(points).join(topic, "request_id", "left").select(
        "request_id", "duplicate_of_request_id", "created_date", "topic"
    )
    originals = requests.join(topics, "request_id", "left").select(
        F.col("request_id").alias("duplicate_of_request_id"),
        F.col("created_date").alias("o_created"), F.col("topic_key").alias("o_topic"),
    )
    met = mine.join(originals, "duplicate_of_request_id")
    wrong = met.where("NOT (o_created < created_date) OR NOT (topic <=> o_topic)")
    rows = summarize(
        [
            broken(requests.where(points != (F.col("status") == "duplicate")),
                   "duplicate_points", "request_id"),
            broken(wrong, "earlier_same_topic", "request_id"),
            broken(requests.where("resulting_report_id IS NOT NULL AND status <> 'done'"),
                   "result_only_when_done", "request_id"),
        ],
        ["duplicate_points", "earlier_same_topic", "result_only_when_done"],
    )
    for status, expected in STATUS_SHARES.items():
        rows = rows.union(
            share(requests, f"share_{status}", F.col("status") == status,
                  expected - 0.03, expected + 0.03)
        )
    done = requests.where("status = 'done'")
    return rows.union(share(done, "done_with_result", F.col("resulting_report_id").isNotNull(),
                            0.70, 0.80))


def reserved_terms(catalog: Catalog, fragments: list[str], keywords: list[str]) -> DataFrame:
    """Reserved name fragments and topic keywords that must not occur, ignoring case."""
    names = (
        catalog.reports.selectExpr("report_id AS record", "name AS text")
        .union(catalog.tables.selectExpr("table_id", "name"))
        .union(catalog.metrics.selectExpr("metric_id", "name"))
    )
    texts = (
        catalog.requests.selectExpr("request_id AS record", "concat_ws(' ', title, description) AS text")
        .union(catalog.reports.selectExpr("report_id", "concat_ws(' ', name, description)"))
    )
    parts, rules = [], []
    for label, df, terms in (("fragment", names, fragments), ("keyword", texts, keywords)):
        hits = df.select("record", F.lower("text").alias("text"))
        tests = F.array_compact(
            F.array(*[F.when(F.contains(F.col("text"), F.lit(t.lower())), F.lit(f"{label}:{t}"))
                      for t in terms])
        )
        found = hits.select("record", F.explode(tests).alias("rule"))
        parts.append(found.select("rule", "record"))
        rules += [f"{label}:{t}" for t in terms]
    return summarize(parts, rules)


def noise(catalog: Catalog, vague: DataFrame, topics: DataFrame, abbreviations: list[str]) -> DataFrame:
    """Deliberate noise: tagged reports, vague descriptions, failed refreshes, topic sizes."""
    reports = catalog.reports
    tags = packed_list(F.col("tags"))
    wanted = F.array(*[F.lit(a) for a in abbreviations])
    shared = F.array_intersect(word_set(F.col("name")), word_set(F.col("description")))
    telling = reports.join(vague, "report_id", "left_semi").where(F.size(shared) > 0)
    sizes = topics.groupBy("topic_key").agg(F.count("*").alias("n"))
    rows = summarize(
        [
            broken(reports.where(F.arrays_overlap(tags, wanted)), "abbreviation_tag", "report_id"),
            broken(telling, "vague_description", "report_id"),
            broken(sizes.where("n NOT BETWEEN 2 AND 8"), "topic_size", "topic_key"),
            broken(catalog.metrics.where("formula IS NULL"), "no_formula", "metric_id"),
        ],
        ["abbreviation_tag", "vague_description", "topic_size", "no_formula"],
    )
    active = reports.where("status = 'active'")
    return rows.union(
        share(active, "failed_share", F.col("refresh_status") == "failed", 0.06, 0.10)
    )


def realism(catalog: Catalog, topics: DataFrame, data_department: str) -> DataFrame:
    """Bounds that keep the catalog life-like: names, tags, owners, usage, texts, people."""
    reports, requests, people = catalog.reports, catalog.requests, catalog.employees
    departments = people.select(F.col("employee_id").alias("owner_id"),
                                F.col("department").alias("owner_department"))
    owned_reports = reports.join(departments, "owner_id", "left")
    owned_tables = catalog.tables.join(departments, "owner_id", "left")
    twice = reports.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    tag_count = F.size(packed_list(F.col("tags")))
    columns = json_columns(F.col("columns_json"))
    complete = F.forall(columns, lambda c: c["name"].isNotNull() & c["type"].isNotNull())
    requester = people.select(F.col("employee_id").alias("requester_id"),
                              F.col("department").alias("r_department"))
    assignee = people.select(F.col("employee_id").alias("assignee_id"),
                             F.col("department").alias("a_department"))
    staffed = requests.join(requester, "requester_id", "left").join(assignee, "assignee_id", "left")
    titles = topics.join(requests.select("request_id", "title"), "request_id").groupBy(
        "topic_key"
    ).agg(F.count("*").alias("n"), F.min("title").alias("low"), F.max("title").alias("high"))
    rows = summarize(
        [
            broken(twice, "report_names_unique", "name"),
            broken(reports.where(~tag_count.between(1, 5)), "tag_count", "report_id"),
            broken(reports.where(~sentence_count(F.col("description")).between(1, 3)),
                   "report_sentences", "report_id"),
            broken(requests.where(~sentence_count(F.col("description")).between(1, 3)),
                   "request_sentences", "request_id"),
            broken(catalog.tables.where(~F.coalesce(complete, F.lit(False))), "column_json",
                   "table_id"),
            broken(tenure(requests, people, "requester_id", "created_date"), "requester_employed",
                   "request_id"),
            broken(tenure(requests, people, "assignee_id", "created_date"), "assignee_employed",
                   "request_id"),
            broken(requests.where("requester_id = assignee_id"), "two_people", "request_id"),
            broken(staffed.where("NOT (department <=> r_department)"), "requester_department",
                   "request_id"),
            broken(titles.where("n > 1 AND low = high"), "titles_vary", "topic_key"),
        ],
        ["report_names_unique", "tag_count", "report_sentences", "request_sentences",
         "column_json", "requester_employed", "assignee_employed", "two_people",
         "requester_department", "titles_vary"],
    )
    active = reports.where("status = 'active'")
    shares = [
        share(owned_reports, "department_matches_owner",
              F.col("department").eqNullSafe(F.col("owner_department")), 0.78, 0.92),
        share(active, "unused_share", F.col("usage_30d") == 0, 0.15, 0.25),
        share(owned_tables, "tables_owned_by_data", F.col("owner_department") == data_department,
              0.70, 1.0),
        share(staffed, "assigned_to_data", F.col("a_department") == data_department, 0.80, 1.0),
    ]
    return reduce(DataFrame.union, shares, rows)


def departed_share(catalog: Catalog) -> DataFrame:
    """Share of active reports, tables and metrics whose owner has left, against its bounds."""
    status = catalog.employees.select(F.col("employee_id").alias("owner_id"),
                                      F.col("status").alias("owner_status"))
    gone = F.col("owner_status") == "left"
    bounds = [
        ("reports", catalog.reports.where("status = 'active'").select("owner_id"), 0.0, 0.18),
        ("tables", catalog.tables.select("owner_id"), 0.15, 0.20),
        ("metrics", catalog.metrics.select("owner_id"), 0.15, 0.20),
    ]
    return reduce(
        DataFrame.union,
        [share(df.join(status, "owner_id"), name, gone, low, high) for name, df, low, high in bounds],
    )


def opening_words(df: DataFrame, text: str) -> DataFrame:
    """First word of every text with its share of all texts that have one; a text may have none."""
    words = df.select(F.regexp_extract(F.lower(text), "([a-z0-9]+)", 1).alias("word")).where("word <> ''")
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def template_tics(catalog: Catalog, limit: float = 0.15) -> DataFrame:
    """Opening words above the limit, per text column."""
    texts = {
        "reports.description": (catalog.reports, "description"),
        "requests.title": (catalog.requests, "title"),
        "requests.description": (catalog.requests, "description"),
    }
    parts = [
        broken(opening_words(df, column).where(F.col("share") > limit), rule, "word")
        for rule, (df, column) in texts.items()
    ]
    return summarize(parts, list(texts))
