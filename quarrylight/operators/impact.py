"""What a changed table affects and who must be told, for every table or a table of requests at once."""

from __future__ import annotations

from dataclasses import replace

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.config import IMPACT_OUTPUT_CHARS, NOTIFY_BROADCAST_TOP, NOTIFY_DETAIL_MAX
from quarrylight.functions.text import record_type
from quarrylight.operators import impact_walks
from quarrylight.operators.handed_graph import Graph, hand_out, handed, narrowed
from quarrylight.operators.limits import fit_to_limit, json_text
from quarrylight.operators.lineage import reach, step_edges, table_closure, table_reach
from quarrylight.operators.ownership import contacts, department_heads
from quarrylight.operators.skew import fan_out_hot_keys, split_hot_keys
from quarrylight.sources.catalog import Catalog, assets, metric_sources
from quarrylight.sources.staging import stage

#: The longest answer that is built as one value. People's IDs are never cut, so an answer can be of any
#: length; beyond this one its rows are in impact_contacts and notified.
PAYLOAD_CHARS = 16_000_000

#: Most people that a digest ranks for a table.
RANKED_PEOPLE = NOTIFY_DETAIL_MAX
#: Assets of one person that are walked side by side; those of a person with more are dealt out in parts of PART_UNITS.
PERSON_UNITS, PART_UNITS = 5_000, 50_000
#: Assets that a task walks from, on average, where there are more than cores.
TASK_UNITS = 500_000


def places_of_people(catalog: Catalog) -> DataFrame:
    """(employee_id, departments): all departments that a person's records name, as JSON."""
    return catalog.employees.groupBy("employee_id").agg(
        F.to_json(F.collect_list(F.struct("department")), {"ignoreNullFields": "false"}).alias("departments")
    )


def _owned(catalog: Catalog, assets: DataFrame, places: bool = False) -> DataFrame:
    """Assets with the contact of their owner; broken where the owner, or a person of the walk, does not exist. With
    places, with the departments of the contact."""
    people = contacts(catalog).selectExpr(
        "employee_id AS owner_id", "contact_id AS notify_id", "resolved", "reason <> 'inconsistent' AS sound"
    )
    if places:
        people = people.join(places_of_people(catalog).withColumnRenamed("employee_id", "notify_id"), "notify_id", "left")
    return assets.join(people, "owner_id", "left").select(
        "*", F.coalesce("resolved", F.lit(False)).alias("owner_resolved"),
        (~F.coalesce("sound", F.lit(False))).alias("broken"),
    ).drop("owner_id", "resolved", "sound")


def report_entries(catalog: Catalog, places: bool = False) -> DataFrame:
    """Every report as an answer lists it: asset_id, told, usage_30d, notify_id, owner_resolved, broken, entry."""
    reports = _owned(
        catalog,
        catalog.reports.select(
            F.col("report_id").alias("asset_id"), "name", "status", "usage_30d", "owner_id"
        ),
        places,
    )
    told = F.col("status") == "active"
    entry = F.struct(
        F.col("asset_id").alias("report_id"), "name", "status", "usage_30d",
        F.when(told, F.col("notify_id")).alias("notify_employee_id"), "owner_resolved",
    )
    return reports.select(
        "asset_id", told.alias("told"), "usage_30d", "notify_id", "owner_resolved", "broken", entry.alias("entry"),
        *(["departments"] if places else []),
    )


def table_graph(catalog: Catalog) -> Graph | None:
    """From every table to its parents, where that is small enough to be handed out (see handed_graph)."""
    if "table_graph" not in catalog.prepared:
        edges = catalog.table_table_edges.selectExpr("child_table_id AS src", "parent_table_id AS dst")
        catalog.prepared["table_graph"] = hand_out(edges, catalog.tables.select(F.col("table_id").alias("id")))
    return catalog.prepared["table_graph"]


def _handed(catalog: Catalog) -> Broadcast:
    if "table_graph_handed" not in catalog.prepared:
        catalog.prepared["table_graph_handed"] = handed(catalog.tables, table_graph(catalog))
    return catalog.prepared["table_graph_handed"]


def known_assets(catalog: Catalog, places: bool = False) -> DataFrame:
    """Every report and metric with what depends on it alone, as affected has it; with the contact's departments if asked for."""
    more = ["departments"] if places else []
    reports = report_entries(catalog, places).select(
        "asset_id", F.lit("report").alias("type"), "told", "usage_30d",
        "notify_id", "owner_resolved", "broken", F.length(json_text(F.col("entry"))).alias("item_chars"), *more,
    )
    metrics = _owned(
        catalog, catalog.metrics.select(F.col("metric_id").alias("asset_id"), "owner_id"), places
    ).select(
        "asset_id", F.lit("metric").alias("type"), F.lit(True).alias("told"),
        F.lit(0).cast("bigint").alias("usage_30d"), "notify_id", "owner_resolved", "broken",
        (F.length("asset_id") + 2).alias("item_chars"), *more,
    )
    return reports.union(metrics).distinct()


def asset_links(catalog: Catalog) -> DataFrame:
    """(asset_id, node): the tables that reports and metrics read."""
    links = catalog.report_table_edges.selectExpr("report_id AS asset_id", "table_id AS node")
    return links.union(metric_sources(catalog).selectExpr("metric_id AS asset_id", "table_id AS node"))


def units(catalog: Catalog) -> DataFrame:
    """What can be affected, a row each: known_assets and the tables with parents, with starts: the tables it reads; of
    a table, itself. starts is no longer than the handed graph. Written once a session."""

    def build() -> DataFrame:
        starts = asset_links(catalog).where("node IS NOT NULL").groupBy("asset_id").agg(F.collect_set("node").alias("starts"))
        read = known_assets(catalog, places=True).join(starts, "asset_id")
        children = catalog.table_table_edges.select(F.col("child_table_id").alias("asset_id")).where(
            "asset_id IS NOT NULL AND parent_table_id IS NOT NULL"
        ).distinct().withColumn("starts", F.array("asset_id"))
        fed = children.select(
            "asset_id", F.lit("table").alias("type"), F.lit(False).alias("told"), F.lit(None).cast("bigint").alias("usage_30d"),
            F.lit(None).cast("string").alias("notify_id"), F.lit(True).alias("owner_resolved"), F.lit(False).alias("broken"),
            (F.length("asset_id") + 2).alias("item_chars"), F.lit(None).cast("string").alias("departments"), "starts",
        )
        return read.select(*fed.columns).union(fed)

    return catalog.once("affected_units", build)


def unit_positions(catalog: Catalog) -> DataFrame:
    """(asset_id, position) of the units, once for each asset; position ascends with asset_id. Written once a session."""

    def build() -> DataFrame:
        ids = units(catalog).select("asset_id").distinct()
        ordered = ids.repartitionByRange(_walk_tasks(units(catalog)), "asset_id").sortWithinPartitions("asset_id")
        return ordered.withColumn("position", F.monotonically_increasing_id())

    return catalog.once("unit_positions", build)


def _walk_tasks(asked: DataFrame) -> int:
    return max(asked.sparkSession.sparkContext.defaultParallelism, asked.count() // TASK_UNITS + 1)


def units_by_person(catalog: Catalog, positions: bool = True) -> tuple[DataFrame, DataFrame]:
    """units in two parts dealt out to be walked: everybody's to tell of them side by side, and those of people with more
    than PERSON_UNITS of them, by person and part. What nobody is told of comes first."""
    placed = units(catalog).withColumn("tell", F.coalesce(F.col("told") & ~F.col("broken"), F.lit(False)))
    if positions:
        placed = placed.join(unit_positions(catalog), "asset_id")
    tasks = _walk_tasks(units(catalog))
    parts = F.ceil(F.col("n") / PART_UNITS)
    # At most one in PERSON_UNITS of the units' number.
    busy = units(catalog).where("told AND NOT broken").groupBy(F.col("notify_id").alias("busy_id")).agg(
        F.count("*").alias("n")
    ).where(F.col("n") > PERSON_UNITS).select("busy_id", parts.alias("parts"))
    met = placed.join(F.broadcast(busy), F.col("tell") & F.col("notify_id").eqNullSafe(F.col("busy_id")), "left")
    few = met.where("parts IS NULL").drop("busy_id", "parts")
    many = met.where("parts IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("asset_id"), F.col("parts")))
    dealt = F.when(F.col("tell"), F.xxhash64("notify_id")).otherwise(F.xxhash64("asset_id"))
    return (
        few.repartition(tasks, dealt).sortWithinPartitions("tell", "notify_id"),
        many.repartition(tasks, "notify_id", "part").sortWithinPartitions("notify_id").drop("busy_id", "parts", "part"),
    )


def list_limits(catalog: Catalog, limit: int) -> list[int]:
    """How many items of each of the four lists can come under a character cap: none is shorter than its shortest."""
    key = f"list_limits_{limit}"
    if key not in catalog.prepared:
        plain = F.length("asset_id") + 2
        row = units(catalog).agg(
            F.min(F.when(F.col("type") == "report", F.col("item_chars"))), F.min(F.when(F.col("type") == "table", plain)),
            F.min(F.when(F.col("type") == "metric", plain)), F.min(F.when(F.col("told") & ~F.col("owner_resolved"), plain)),
        ).first()
        catalog.prepared[key] = [limit // ((shortest or 2) + 1) + 1 for shortest in row]
    return catalog.prepared[key]


def digest(catalog: Catalog, limit: int | None = None, departments: bool = False, people: bool = False) -> DataFrame:
    """What the walks from all units add up to for every table (see impact_walks.DIGEST): sums and parts of busy people
    always, first items under a character cap, departments and first people where asked for. Written once a session;
    one that is there and has what is asked for is taken."""
    held = catalog.prepared.setdefault("digests", {})
    for (cap, places, ranked), name in held.items():
        if name in catalog.built and (limit is None or cap == limit) and places >= departments and ranked >= people:
            return catalog.built[name]
    name = f"impact_digest_{limit}_{departments}_{people}"

    def build() -> DataFrame:
        side_by_side, parted = units_by_person(catalog, limit is not None)
        most = None if limit is None else list_limits(catalog, limit)

        def walked(df: DataFrame, apart: bool) -> DataFrame:
            walk = impact_walks.digest(_handed(catalog), most, RANKED_PEOPLE if people else 0, apart, departments)
            return df.mapInArrow(walk, impact_walks.DIGEST)

        return walked(side_by_side, False).union(walked(parted, True))

    built = catalog.once(name, build)
    held[limit, departments, people] = name
    return built


def _busy_people(catalog: Catalog) -> DataFrame:
    """The people whose assets were dealt out over tasks, as rows of impact_contacts."""
    return catalog.once("busy_people", lambda: _put_together(digest(catalog).where(F.col("kind") == impact_walks.PARTIAL).select(
        "table_id", F.col("label").alias("employee_id"), F.col("n").alias("report_count"), F.col("m").alias("metric_count"),
        F.col("usage").alias("total_usage_30d"), F.col("fallback").alias("via_fallback"), F.col("chars").alias("id_chars"),
    )))


def _put_together(contacts_in_parts: DataFrame) -> DataFrame:
    return contacts_in_parts.groupBy("table_id", "employee_id").agg(
        F.sum("report_count").alias("report_count"), F.sum("metric_count").alias("metric_count"),
        F.sum("total_usage_30d").alias("total_usage_30d"), F.bool_or("via_fallback").alias("via_fallback"),
        F.sum("id_chars").alias("id_chars"),
    )


def _department_sums(catalog: Catalog) -> DataFrame:
    """(table_id, departments, people, reports): people told, by the departments they are in; written once a session."""

    def build() -> DataFrame:
        busy = _busy_people(catalog).join(places_of_people(catalog), "employee_id", "left").select(
            "table_id", "departments", F.lit(1).cast("bigint").alias("people"), F.col("report_count").alias("reports")
        )
        rest = digest(catalog, departments=True).where(F.col("kind") == impact_walks.DEPARTMENTS).select(
            "table_id", F.col("label").alias("departments"), F.col("n").alias("people"), F.col("m").alias("reports")
        )
        return rest.union(busy).groupBy("table_id", "departments").agg(F.sum("people").alias("people"), F.sum("reports").alias("reports"))

    return catalog.once("department_sums", build)


def _list_sums(catalog: Catalog) -> DataFrame:
    """(table_id, cut_order, n, chars): length of each list of an answer before anything is cut, of the broken assets and of the
    people whose assets were not dealt out."""
    return digest(catalog).where(F.col("kind") == impact_walks.SUMS).groupBy("table_id", "cut_order").agg(
        F.sum("n").alias("n"), F.sum("chars").alias("chars")
    )


def affected(catalog: Catalog) -> DataFrame:
    """One row per table and report or metric downstream of it, with who is told about it.

    Columns: table_id, asset_id, type, told (somebody is told: active reports and all metrics),
    usage_30d, notify_id, owner_resolved, broken (its owner cannot be looked up), item_chars (length of
    its entry in the answer).
    Where the graph of tables can be handed out, each asset's tables are walked to in its task and no pair is
    shuffled or written. Else pairs are dealt out by asset with their two IDs alone: there assets reached over
    several tables are removed and what depends on the asset alone is joined, without another shuffle of the pairs.
    A task holds an asset's tables, at most all of them, side by side, so the written columns of the asset are runs.
    Links of a hub table are spread over salts.
    """
    if table_graph(catalog) is not None:
        return _walked_pairs(catalog, units(catalog).where("type <> 'table'"))

    def build() -> DataFrame:
        known = known_assets(catalog)
        salted, hot = split_hot_keys(asset_links(catalog), "node", ["asset_id"])
        seeds = fan_out_hot_keys(table_reach(catalog), hot, "node")
        pairs = (
            seeds.join(salted, ["node", "salt"])
            .select(F.col("seed").alias("table_id"), "asset_id")
            .repartition("asset_id")
            .distinct()
        )
        return pairs.join(known, "asset_id").select("table_id", *known.columns)

    return catalog.once("affected", build)


def _walked_pairs(catalog: Catalog, asked: DataFrame) -> DataFrame:
    """Units, with some of their columns, as a row for every table that affects them."""
    columns = [c for c in asked.columns if c not in ("starts", "departments")]
    schema = ", ".join(["table_id string", *(f"{name} {kind}" for name, kind in asked.select(*columns).dtypes)])
    return asked.mapInArrow(impact_walks.pairs(_handed(catalog), columns), schema)


def impact_closure(catalog: Catalog) -> DataFrame:
    """(table_id, asset_id, type) for tables, reports and metrics downstream of every table."""
    if table_graph(catalog) is not None:
        return _walked_pairs(catalog, units(catalog).select("asset_id", "type", "starts"))
    tables = table_closure(catalog).select(
        F.col("seed").alias("table_id"), F.col("node").alias("asset_id"),
        F.lit("table").alias("type"),
    )
    return tables.union(affected(catalog).select("table_id", "asset_id", "type"))


def notified(catalog: Catalog) -> DataFrame:
    """The affected assets somebody is told about: active reports and all metrics, but for broken ones."""
    if table_graph(catalog) is not None:
        return _walked_pairs(catalog, units(catalog).where("told AND NOT broken"))
    return affected(catalog).where("told AND NOT broken")


def impact_contacts(catalog: Catalog) -> DataFrame:
    """One row per (table, person): counts, affected usage, whether a fallback was used, and how
    many characters the person's IDs take in an answer. Summed in the walks where the graph of tables can be
    handed out; else written once per session."""
    if table_graph(catalog) is not None:
        told, parted = (df.drop("departments") for df in units_by_person(catalog, positions=False))
        walk = impact_walks.contacts(_handed(catalog))
        return told.where("tell").mapInArrow(walk, impact_walks.CONTACTS).union(
            _put_together(parted.mapInArrow(walk, impact_walks.CONTACTS))
        )

    def build() -> DataFrame:
        return (
            notified(catalog)
            .groupBy("table_id", F.col("notify_id").alias("employee_id"))
            .agg(
                F.count_if(F.col("type") == "report").alias("report_count"),
                F.count_if(F.col("type") == "metric").alias("metric_count"),
                F.sum("usage_30d").alias("total_usage_30d"),
                F.bool_or(~F.col("owner_resolved")).alias("via_fallback"),
                F.sum(F.length("asset_id") + 2).alias("id_chars"),
            )
        )

    return catalog.once("impact_contacts", build)


def notify_ranked(catalog: Catalog, limit: int = NOTIFY_DETAIL_MAX) -> DataFrame:
    """The first people per table by affected usage (desc), then ID.

    An answer never lists more than twenty; impact_contacts holds everybody, unranked.
    """
    order = Window.partitionBy("table_id").orderBy(F.desc("total_usage_30d"), "employee_id")

    def first(people: DataFrame, n: int) -> DataFrame:
        return people.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

    if table_graph(catalog) is None or limit > RANKED_PEOPLE:
        return first(impact_contacts(catalog), limit)
    # Each task's first people, of whom the first are the first of all.
    leading = digest(catalog, people=True).where(F.col("kind") == impact_walks.PEOPLE).select(
        "table_id", F.col("label").alias("employee_id"), F.col("n").alias("report_count"), F.col("m").alias("metric_count"),
        F.col("usage").alias("total_usage_30d"), F.col("fallback").alias("via_fallback"), F.col("chars").alias("id_chars"),
    )
    ranked = catalog.once("notify_ranked", lambda: first(leading.union(_busy_people(catalog)), RANKED_PEOPLE))
    return ranked.where(F.col("rank") <= limit)


def told_counts(catalog: Catalog) -> DataFrame:
    """(table_id, people) for every table somebody is told of."""
    if table_graph(catalog) is not None:
        rest = _list_sums(catalog).where(F.col("cut_order") == impact_walks.TOLD).select("table_id", F.col("n").alias("people"))
        busy = _busy_people(catalog).groupBy("table_id").agg(F.count("*").alias("people"))
        return rest.union(busy).groupBy("table_id").agg(F.sum("people").alias("people"))
    return impact_contacts(catalog).groupBy("table_id").agg(F.count("*").alias("people"))


def notify_modes(catalog: Catalog) -> DataFrame:
    """Per table: how many people, and whether they are listed or broadcast to."""
    return catalog.tables.select("table_id").join(told_counts(catalog), "table_id", "left").select(
        "table_id",
        F.coalesce("people", F.lit(0)).alias("notify_total_count"),
        F.when(F.coalesce("people", F.lit(0)) <= NOTIFY_DETAIL_MAX, "individual")
        .otherwise("broadcast").alias("notify_mode"),
    )


def notify_list(catalog: Catalog) -> DataFrame:
    """The people an answer lists: everyone in individual mode, the top ten in broadcast mode."""
    top = notify_ranked(catalog)
    shown = top.join(notify_modes(catalog), "table_id").where(
        (F.col("notify_mode") == "individual") | (F.col("rank") <= NOTIFY_BROADCAST_TOP)
    )
    omitted = F.when(
        F.col("notify_mode") == "broadcast", F.col("notify_total_count") - NOTIFY_BROADCAST_TOP
    ).otherwise(0)
    return shown.withColumn("notify_omitted_count", omitted.cast("bigint"))


def department_counts(catalog: Catalog) -> DataFrame:
    """(table_id, department, people_count, report_count) of the people to be told of each table."""
    if table_graph(catalog) is not None:
        each = F.explode(F.from_json("departments", "array<struct<department string>>"))
        return _department_sums(catalog).select("table_id", "people", "reports", each.alias("place")).groupBy(
            "table_id", F.col("place.department").alias("department")
        ).agg(F.sum("people").alias("people_count"), F.sum("reports").alias("report_count"))
    people = catalog.employees.select("employee_id", "department")
    return impact_contacts(catalog).join(people, "employee_id").groupBy("table_id", "department").agg(
        F.count("*").alias("people_count"), F.sum("report_count").alias("report_count")
    )


def impact_rollup(catalog: Catalog) -> DataFrame:
    """Broadcast tables: people and reports per department with its head, ranked by people."""
    wide = notify_modes(catalog).where("notify_mode = 'broadcast'").select("table_id")
    grouped = department_counts(catalog).join(wide, "table_id").groupBy("table_id", "department").agg(
        F.sum("people_count").alias("people_count"), F.sum("report_count").alias("report_count")
    )
    order = Window.partitionBy("table_id").orderBy(F.desc("people_count"), "department")
    return (
        grouped.join(F.broadcast(department_heads(catalog)), "department", "left")
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
        .select(
            "table_id", "department", F.col("head_id").alias("head_employee_id"),
            "people_count", "report_count", "rank",
        )
    )


def _sizes(catalog: Catalog) -> tuple[DataFrame, DataFrame]:
    """Affected assets, and affected tables, counted per table."""
    if table_graph(catalog) is not None:
        names = {1: "affected_report_count", 3: "affected_metric_count", 4: "unresolved_count", 2: "affected_table_count"}
        counts = _list_sums(catalog).groupBy("table_id").agg(
            *[F.coalesce(F.sum(F.when(F.col("cut_order") == order, F.col("n"))), F.lit(0)).alias(name) for order, name in names.items()]
        )
        return counts.drop("affected_table_count"), counts.select("table_id", "affected_table_count")
    sizes = affected(catalog).groupBy("table_id").agg(
        F.count_if(F.col("type") == "report").alias("affected_report_count"),
        F.count_if(F.col("type") == "metric").alias("affected_metric_count"),
        F.count_if(F.col("told") & ~F.col("owner_resolved")).alias("unresolved_count"),
    )
    downstream = table_closure(catalog).groupBy(F.col("seed").alias("table_id")).agg(
        F.count("*").alias("affected_table_count")
    )
    return sizes, downstream


def impact_summary(catalog: Catalog) -> DataFrame:
    """Exact counts per table, taken before any list is cut."""
    sizes, downstream = _sizes(catalog)
    zero = {
        name: 0
        for name in (
            "affected_report_count", "affected_metric_count", "unresolved_count",
            "affected_table_count",
        )
    }
    omitted = F.when(
        F.col("notify_mode") == "broadcast", F.col("notify_total_count") - NOTIFY_BROADCAST_TOP
    ).otherwise(0)
    return (
        notify_modes(catalog).join(sizes, "table_id", "left").join(downstream, "table_id", "left")
        .fillna(zero)
        .withColumn("notify_omitted_count", omitted.cast("bigint"))
    )


def shortest_item(catalog: Catalog) -> int:
    """Characters that any item of a list takes at least: the shortest ID, two quotes and a comma."""
    if "shortest_item" not in catalog.prepared:
        shortest = assets(catalog).agg(F.min(F.length("asset_id"))).first()[0]
        catalog.prepared["shortest_item"] = (shortest or 0) + 3
    return catalog.prepared["shortest_item"]


def impact_items(catalog: Catalog) -> DataFrame:
    """The items of the four lists an answer may cut: reports first, unresolved IDs last."""
    assets = affected(catalog)
    plain = F.length("asset_id") + 2
    reports = assets.where("type = 'report'").select(
        "table_id", F.lit(1).alias("cut_order"), (-F.col("usage_30d")).alias("place"),
        "asset_id", "item_chars",
    )
    unplaced = F.lit(0).cast("bigint").alias("place")
    tables = (
        table_closure(catalog)
        .select(F.col("seed").alias("table_id"), F.col("node").alias("asset_id"))
        .select(
            "table_id", F.lit(2).alias("cut_order"), unplaced, "asset_id",
            plain.alias("item_chars"),
        )
    )
    metrics = assets.where("type = 'metric'").select(
        "table_id", F.lit(3).alias("cut_order"), unplaced, "asset_id", "item_chars"
    )
    unresolved = assets.where("told AND NOT owner_resolved").select(
        "table_id", F.lit(4).alias("cut_order"), unplaced, "asset_id", plain.alias("item_chars")
    )
    return reports.union(tables).union(metrics).union(unresolved)


def _joined_chars(chars, count):
    """Characters of `count` items with commas between them."""
    return F.coalesce(chars, F.lit(0)) + F.greatest(F.coalesce(count, F.lit(0)) - 1, F.lit(0))


def payload_base(catalog: Catalog) -> DataFrame:
    """table_id, base_chars: length of the answer as JSON with its four cuttable lists empty.

    The notify list and the rollup are never cut, so they belong to the base. Their length is
    summed from the parts; the lists of IDs inside are never gathered.
    """
    names = catalog.employees.select("employee_id", "full_name")
    no_ids = F.array().cast("array<string>")
    entry = json_text(
        F.struct(
            "employee_id", "full_name", no_ids.alias("report_ids"), no_ids.alias("metric_ids"),
            "total_usage_30d", "via_fallback",
        )
    )
    commas = F.greatest(F.col("report_count") - 1, F.lit(0)) + F.greatest(
        F.col("metric_count") - 1, F.lit(0)
    )
    people = (
        notify_list(catalog).join(names, "employee_id")
        .groupBy("table_id")
        .agg(
            F.sum(F.length(entry) + F.col("id_chars") + commas).alias("people_chars"),
            F.count("*").alias("people"),
        )
    )
    row = json_text(F.struct("department", "head_employee_id", "people_count", "report_count"))
    rollup = impact_rollup(catalog).groupBy("table_id").agg(
        F.sum(F.length(row)).alias("rollup_chars"), F.count("*").alias("departments")
    )
    empty = json_text(
        F.struct(
            "table_id", "notify_mode", "notify_total_count", "notify_omitted_count",
            "affected_report_count", "affected_metric_count", no_ids.alias("affected_tables"),
            no_ids.alias("affected_reports"), no_ids.alias("affected_metrics"),
            no_ids.alias("notify"), no_ids.alias("notify_rollup"),
            no_ids.alias("unresolved_asset_ids"), F.lit(False).alias("truncated"),
        )
    )
    base = (
        F.length(empty)
        + _joined_chars(F.col("people_chars"), F.col("people"))
        + _joined_chars(F.col("rollup_chars"), F.col("departments"))
    )
    return (
        impact_summary(catalog).join(people, "table_id", "left").join(rollup, "table_id", "left")
        .select("table_id", base.alias("base_chars"))
    )


def impact_shown(catalog: Catalog, limit: int = IMPACT_OUTPUT_CHARS) -> DataFrame:
    """The list items an answer shows: table_id, cut_order, rank, asset_id, truncated. Written once a session."""


    def build() -> DataFrame:
        if table_graph(catalog) is None:
            return fit_to_limit(
                payload_base(catalog), impact_items(catalog), ["table_id"], ["place", "asset_id"], limit, shortest_item(catalog)
            )
        # One walk for all that an answer needs.
        first = digest(catalog, limit, departments=True, people=True).where(F.col("kind") == impact_walks.ITEMS).select(
            "table_id", "cut_order", "place", "position", F.col("chars").alias("item_chars")
        ).repartition("table_id")
        most = F.element_at(F.array(*[F.lit(n) for n in list_limits(catalog, limit)]), F.col("cut_order"))
        totals = _list_sums(catalog).where(F.col("cut_order") <= impact_walks.LISTS).groupBy("table_id").agg(F.sum(F.col("chars") + F.col("n") - 1).alias("_all"))
        shown = fit_to_limit(
            payload_base(catalog), first, ["table_id"], ["place", "position"], limit, shortest_item(catalog), totals, most
        )
        return shown.join(unit_positions(catalog), "position").drop("position")

    return catalog.once(f"impact_shown_{limit}", build)


def impact_analysis(catalog: Catalog, limit: int = IMPACT_OUTPUT_CHARS) -> DataFrame:
    """One row per table: exact counts, mode, and the lists cut to the character cap.

    People come from notify_list, their assets from notified: both are whole tables of their
    own, so no person's IDs are gathered into one value.
    """
    ranked = F.struct("rank", "asset_id")

    def ids(order: int, name: str):
        chosen = F.array_sort(F.collect_list(F.when(F.col("cut_order") == order, ranked)))
        return F.transform(chosen, lambda item: item["asset_id"]).alias(name)

    shown = impact_shown(catalog, limit).groupBy("table_id").agg(
        ids(1, "affected_reports"), ids(2, "affected_tables"), ids(3, "affected_metrics"),
        ids(4, "unresolved_asset_ids"), F.count("*").alias("shown"),
    )
    everything = (
        F.col("affected_report_count") + F.col("affected_table_count")
        + F.col("affected_metric_count") + F.col("unresolved_count")
    )
    nothing = F.array().cast("array<string>")
    lists = ["affected_reports", "affected_tables", "affected_metrics", "unresolved_asset_ids"]
    return impact_summary(catalog).join(shown, "table_id", "left").select(
        "table_id", "notify_mode", "notify_total_count", "notify_omitted_count",
        "affected_report_count", "affected_metric_count",
        *[F.coalesce(name, nothing).alias(name) for name in lists],
        (F.coalesce("shown", F.lit(0)) < everything).alias("truncated"),
    )


def impact_fanout(catalog: Catalog, limit: int = IMPACT_OUTPUT_CHARS) -> DataFrame:
    """Impact size of every table with its layer."""
    layers = catalog.tables.select("table_id", "name", "layer")
    shown = impact_shown(catalog, limit).groupBy("table_id").agg(
        F.sum("item_chars").alias("chars"), F.count("*").alias("items"),
        F.count_distinct("cut_order").alias("lists"), F.bool_or("truncated").alias("cut"),
    )
    cut = F.coalesce("cut", F.lit(False))
    size = F.col("base_chars") + F.coalesce(
        F.col("chars") + F.col("items") - F.col("lists"), F.lit(0)
    ) - F.when(cut, 1).otherwise(0)
    return (
        impact_summary(catalog).join(layers, "table_id")
        .join(payload_base(catalog), "table_id")
        .join(shown, "table_id", "left")
        .select(
            "table_id", "name", "layer", "notify_mode", "notify_total_count",
            "affected_report_count", "affected_metric_count",
            size.cast("bigint").alias("payload_chars"), cut.alias("truncated"),
        )
    )


def asked_scope(catalog: Catalog, asked: DataFrame) -> Catalog:
    """The catalog narrowed to answers about asked(table_id): only these tables are walked from, or to."""
    graph = table_graph(catalog)
    if graph is not None:
        tables = stage(catalog.tables.join(asked, "table_id", "left_semi"), "asked-tables")
        ids = tables.select("table_id").distinct().toArrow()["table_id"].combine_chunks()
        return replace(
            catalog, tables=tables, built={"contacts": contacts(catalog), "affected_units": units(catalog), "unit_positions": unit_positions(catalog)},
            prepared={"shortest_item": shortest_item(catalog), "table_graph": narrowed(graph, ids)},
        )
    if "table_steps" not in catalog.prepared:
        catalog.prepared["table_steps"] = step_edges(
            catalog.table_table_edges.selectExpr("parent_table_id AS src", "child_table_id AS dst")
        )
    tables = stage(catalog.tables.join(asked, "table_id", "left_semi"), "asked-tables")
    found = reach(catalog.prepared["table_steps"], tables.select(F.col("table_id").alias("seed")))
    closure = stage(found.select("seed", "node"), "asked-closure")
    return replace(
        catalog, tables=tables, built={"contacts": contacts(catalog), "table_closure": closure},
        prepared={"shortest_item": shortest_item(catalog), "table_graph": None},
    )


def impact_payloads(catalog: Catalog, limit: int = IMPACT_OUTPUT_CHARS) -> DataFrame:
    """table_id, payload (the answer as JSON; NULL beyond PAYLOAD_CHARS), payload_chars, truncated, broken.

    Lengths are known before anything is gathered, so only lists of answers within PAYLOAD_CHARS are made.
    """
    sizes = stage(impact_fanout(catalog, limit).select("table_id", "payload_chars", "truncated"), "impact-sizes")
    fitting = sizes.where(F.col("payload_chars") <= PAYLOAD_CHARS).select("table_id")

    def in_order(chosen: Column, order: Column, value: Column, name: str) -> Column:
        return F.transform(
            F.array_sort(F.collect_list(F.when(chosen, F.struct(order.alias("at"), value.alias("value"))))),
            lambda item: item["value"],
        ).alias(name)

    names = [(2, "affected_tables"), (3, "affected_metrics"), (4, "unresolved_asset_ids")]
    shown = impact_shown(catalog, limit).join(fitting, "table_id", "left_semi")
    entries = report_entries(catalog).select("asset_id", "entry")
    lists = shown.join(entries, "asset_id", "left").groupBy("table_id").agg(
        in_order(F.col("cut_order") == 1, F.col("rank"), F.col("entry"), "affected_reports"),
        *[in_order(F.col("cut_order") == n, F.col("rank"), F.col("asset_id"), name) for n, name in names],
    )
    listed = notify_list(catalog).join(fitting, "table_id", "left_semi").select(
        "table_id", "employee_id", "rank", "total_usage_30d", "via_fallback"
    )
    assets_of = notified(catalog).select("table_id", F.col("notify_id").alias("employee_id"), "asset_id", "type")
    persons = listed.join(assets_of, ["table_id", "employee_id"]).groupBy(*listed.columns).agg(
        *[in_order(F.col("type") == kind, F.col("asset_id"), F.col("asset_id"), f"{kind}_ids") for kind in ("report", "metric")]
    )
    person = F.struct("employee_id", "full_name", "report_ids", "metric_ids", "total_usage_30d", "via_fallback")
    notify = persons.join(catalog.employees.select("employee_id", "full_name"), "employee_id").groupBy("table_id").agg(
        in_order(F.lit(True), F.col("rank"), person, "notify")
    )
    row = F.struct("department", "head_employee_id", "people_count", "report_count")
    rollup = impact_rollup(catalog).groupBy("table_id").agg(in_order(F.lit(True), F.col("rank"), row, "notify_rollup"))
    if table_graph(catalog) is not None:
        spoilt = _list_sums(catalog).where(F.col("cut_order") == impact_walks.BROKEN)
    else:
        spoilt = affected(catalog).where("broken")
    broken = spoilt.select("table_id", F.lit(True).alias("broken")).distinct()
    whole = impact_summary(catalog).join(sizes, "table_id")
    for part in (lists, notify, rollup, broken):
        whole = whole.join(part, "table_id", "left")
    kinds = {**dict(lists.dtypes), **dict(notify.dtypes), **dict(rollup.dtypes)}

    def full(name: str) -> Column:
        return F.coalesce(name, F.array().cast(kinds[name])).alias(name)

    answer = F.struct(
        "table_id", "notify_mode", "notify_total_count", "notify_omitted_count", "affected_report_count",
        "affected_metric_count", full("affected_tables"), full("affected_reports"), full("affected_metrics"),
        full("notify"), full("notify_rollup"), full("unresolved_asset_ids"), "truncated",
    )
    return whole.select(
        "table_id", F.when(F.col("payload_chars") <= PAYLOAD_CHARS, json_text(answer)).alias("payload"), "payload_chars",
        "truncated", F.coalesce("broken", F.lit(False)).alias("broken"),
    )


def impact_answers(catalog: Catalog, requests: DataFrame, limit: int = IMPACT_OUTPUT_CHARS) -> DataFrame:
    """requests(request_id, table_id) -> request_id, table_id, payload, payload_chars, truncated, error; a row each.

    error(code, message) is INVALID_ARGUMENT for what is no table ID, NOT_FOUND for an unknown table, INTERNAL where
    the owner of something affected cannot be looked up, TOO_LARGE beside the counted length of an answer over
    PAYLOAD_CHARS; it is NULL beside a payload. IDs are trimmed. A table is walked once however often it is asked for.
    """
    table = F.regexp_replace(F.coalesce("table_id", F.lit("")), r"^\s+|\s+$", "")
    wanted = requests.select("request_id", table.alias("table_id"))
    asked = stage(wanted.where(record_type(F.col("table_id")) == "table").select("table_id").distinct(), "asked")
    answers = stage(impact_payloads(asked_scope(catalog, asked), limit), "impact-answers")
    salted, hot = split_hot_keys(wanted, "table_id", ["request_id"])
    answered = salted.join(fan_out_hot_keys(answers, hot, "table_id"), ["table_id", "salt"], "left")

    def error(code: str, message: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.concat("table_id", F.lit(message)).alias("message"))

    kind = F.coalesce(record_type(F.col("table_id")), F.lit(""))
    problem = (
        F.when(kind != "table", error("INVALID_ARGUMENT", " is not a table ID"))
        .when(F.col("payload_chars").isNull(), error("NOT_FOUND", " does not exist"))
        .when(F.col("broken"), error("INTERNAL", " affects an asset whose owner cannot be looked up"))
        .when(F.col("payload").isNull(), error("TOO_LARGE", " has an answer too long for one value"))
    )
    fine = F.col("error").isNull()
    return answered.withColumn("error", problem).select(
        "request_id", "table_id", F.when(fine, F.col("payload")).alias("payload"),
        F.when(fine | (F.col("error.code") == "TOO_LARGE"), F.col("payload_chars")).alias("payload_chars"),
        F.when(fine, F.col("truncated")).alias("truncated"), "error",
    )


def fanout_summary(catalog: Catalog) -> DataFrame:
    """Notify modes, largest audience and cut answers, per layer and overall."""
    return impact_fanout(catalog).rollup("layer").agg(
        F.count_if(F.col("notify_mode") == "individual").alias("individual"),
        F.count_if(F.col("notify_mode") == "broadcast").alias("broadcast"),
        F.max("payload_chars").alias("max_payload_chars"),
        F.count_if("truncated").alias("truncated_count"),
    ).withColumn("layer", F.coalesce("layer", F.lit("all")))
