"""Lineage: typed nodes and edges, breadth-first reach from many seeds at once, DAG check."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.config import MAX_TRACE_DEPTH, TRACE_NODE_LIMIT
from quarrylight.operators.skew import fan_out_hot_keys, split_hot_keys
from quarrylight.sources.catalog import Catalog, assets, metric_sources
from quarrylight.sources.staging import stage

#: The depth of a walk without bounds.
NO_LIMIT = 2**31 - 1


def lineage_nodes(catalog: Catalog) -> DataFrame:
    """id, type, name, layer, status of every table, report and metric."""
    return assets(catalog).select(F.col("asset_id").alias("id"), "type", "name", "layer", "status")


def lineage_edges(catalog: Catalog) -> DataFrame:
    """src -> dst in the direction data flows, with the kind of edge."""
    parts = [
        catalog.table_table_edges.select(
            F.col("parent_table_id").alias("src"), F.col("child_table_id").alias("dst"),
            F.lit("table_table").alias("kind"),
        ),
        catalog.report_table_edges.select(
            F.col("table_id").alias("src"), F.col("report_id").alias("dst"),
            F.lit("table_report").alias("kind"),
        ),
        metric_sources(catalog).select(
            F.col("table_id").alias("src"), F.col("metric_id").alias("dst"),
            F.lit("table_metric").alias("kind"),
        ),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


@dataclass
class StepEdges:
    """Edges ready to be walked: written once, with the links of hub nodes spread over salts.

    edges(src, dst, begins, ends, salt): an edge begins where nothing leads to its src and ends
    where nothing leads on from its dst.
    """

    edges: DataFrame
    hubs: DataFrame | None


def step_edges(edges: DataFrame) -> StepEdges:
    links = stage(edges.select("src", "dst"), "links")
    tails = links.select(F.col("src").alias("dst")).distinct().withColumn("_onward", F.lit(True))
    heads = links.select(F.col("dst").alias("src")).distinct().withColumn("_before", F.lit(True))
    marked = links.join(tails, "dst", "left").join(heads, "src", "left").select(
        "src", "dst", F.col("_before").isNull().alias("begins"), F.col("_onward").isNull().alias("ends")
    )
    salted, hot = split_hot_keys(marked, "src", ["dst"])
    salted, hot = stage(salted, "edges"), stage(hot, "hubs")
    return StepEdges(salted, None if hot.isEmpty() else hot)


def _step(steps: StepEdges, which: str, frontier: DataFrame, keep: list[str]) -> DataFrame:
    """The nodes one step from the frontier's nodes over the edges that pass a condition."""
    at, edges = frontier.withColumnRenamed("node", "src"), steps.edges.where(which)
    if steps.hubs is not None:
        met = fan_out_hot_keys(at, steps.hubs, "src").join(edges, ["src", "salt"])
    else:
        met = at.join(edges, "src")
    return met.select(*keep, F.col("dst").alias("node"))


def reach(
    edges: DataFrame | StepEdges,
    seeds: DataFrame,
    max_depth: int | None = None,
    hops_per_round: int = 4,
) -> DataFrame:
    """(seed, node, distance) for everything reachable from each seed, seeds excluded.

    A `depth` column on seeds bounds each seed on its own.
    """
    return _reach(edges, seeds, max_depth, hops_per_round).select("seed", "node", "distance")


def _reach(
    edges: DataFrame | StepEdges, seeds: DataFrame, max_depth: int | None, hops_per_round: int = 4
) -> DataFrame:
    """reach with the `depth` of every seed, the largest one where a seed has several.

    Only what lies between is walked hop by hop. Seeds that nothing leads to take their first step at
    once and share the walks of the nodes they come to; nodes that lead nowhere are met in one step
    from everything walked. So each pair with such an end is shuffled once, to find its distance.
    """
    steps = edges if isinstance(edges, StepEdges) else step_edges(edges)
    depth = F.col("depth") if "depth" in seeds.columns else F.lit(max_depth or NO_LIMIT)
    if max_depth is not None:
        depth = F.when(depth > max_depth, max_depth).otherwise(depth)
    asked = seeds.select("seed", depth.alias("depth")).groupBy("seed").agg(F.max("depth").alias("depth"))
    kind = asked.schema["depth"].dataType
    begun = asked.where("depth >= 1").withColumn("node", F.col("seed"))
    first = stage(
        _step(steps, "begins", begun, ["seed", "depth"]).distinct().withColumnRenamed("node", "via"), "first-steps"
    )
    sharing = not first.isEmpty()
    starts = asked.withColumn("own", F.col("depth"))
    if sharing:
        vias = first.select("via", (F.col("depth") - 1).cast(kind), F.lit(None).cast(kind))
        starts = starts.union(vias).groupBy("seed").agg(F.max("depth").alias("depth"), F.max("own").alias("own"))
    walked = _walked(steps, starts, max_depth, hops_per_round)
    ended = _step(
        steps, "ends AND NOT begins", walked.where(F.col("distance") < F.col("depth")),
        ["seed", "depth", "own", (F.col("distance") + 1).alias("distance")],
    )
    behind = walked.unionByName(ended)
    mine = "own IS NOT NULL AND distance BETWEEN 1 AND own"
    out = ["seed", F.col("own").alias("depth"), "node", "distance"]
    last = ended.where(mine).select(*out)
    if sharing:
        links, hot = split_hot_keys(first, "via", ["seed"])
        met = behind.select(F.col("seed").alias("via"), "node", "distance")
        if hot.isEmpty():
            met = met.join(first, "via")
        else:
            met = fan_out_hot_keys(met, hot, "via").join(links, ["via", "salt"])
        last = last.union(
            met.where(F.col("distance") < F.col("depth"))
            .select("seed", "depth", "node", (F.col("distance") + 1).alias("distance"))
        )
    nearest = last.groupBy("seed", "depth", "node").agg(F.min("distance").alias("distance"))
    return walked.where(mine).select(*out).union(nearest).where("seed <> node")


def _walked(steps: StepEdges, starts: DataFrame, max_depth: int | None, hops_per_round: int) -> DataFrame:
    """starts(seed, depth, own) with every node walked to and its distance, the seed itself at 0.

    Edges that begin or end are left out. A round walks several hops in one plan; the hops share their
    shuffles (Spark reuses equal exchanges), so a round costs as many joins as it has hops. What a
    round finds is reduced to the shortest distance, rid of pairs found before (so cycles end the
    walk) and written once; the pairs first met at its last hop start the next round.
    """
    between, keep = "NOT begins AND NOT ends", ["seed", "depth", "own"]
    # Partitioned by seed and node, so that no step clusters all of one seed's pairs in a task.
    start = starts.withColumn("node", F.col("seed")).repartition("seed", "node")
    single = max_depth is not None and max_depth <= max(hops_per_round, MAX_TRACE_DEPTH)
    if not single:
        start = stage(start, "walk-starts")
    here = start.withColumn("distance", F.lit(0))
    seen, frontier, rounds, walked = start.select("seed", "node"), start, [here], 0
    while max_depth is None or walked < max_depth:
        hops = max_depth if single else hops_per_round
        if max_depth is not None:
            hops = min(hops, max_depth - walked)
        found, at = [here] if single else [], frontier
        for hop in range(1, hops + 1):
            at = _step(steps, between, at.where(F.col("depth") >= walked + hop), keep).distinct()
            found.append(at.withColumn("distance", F.lit(walked + hop)))
        walked += hops
        nearest = reduce(DataFrame.unionByName, found).groupBy(*keep, "node").agg(
            F.min("distance").alias("distance")
        )
        if single:
            return stage(nearest, "walked")
        fresh = stage(nearest.join(seen, ["seed", "node"], "left_anti"), f"reach{walked}")
        if fresh.isEmpty():
            break
        rounds.append(fresh)
        seen = seen.union(fresh.select("seed", "node"))
        frontier = fresh.where(F.col("distance") == walked).drop("distance")
    return reduce(DataFrame.unionByName, rounds)


def table_closure(catalog: Catalog) -> DataFrame:
    """(seed, node) for every pair of tables where seed feeds node, at any distance."""

    def build() -> DataFrame:
        edges = catalog.table_table_edges.selectExpr(
            "parent_table_id AS src", "child_table_id AS dst"
        )
        return reach(edges, edges.select(F.col("src").alias("seed"))).select("seed", "node")

    return catalog.once("table_closure", build)


def table_reach(catalog: Catalog) -> DataFrame:
    """table_closure with each table also reaching itself."""
    own = catalog.tables.select(F.col("table_id").alias("seed"), F.col("table_id").alias("node"))
    return table_closure(catalog).union(own)


def reach_within(edges: DataFrame | StepEdges, requests: DataFrame) -> DataFrame:
    """requests(seed, depth) -> (seed, depth, node, distance).

    Each seed is walked once, to the largest depth asked for it. The largest of all is read first (one
    small job), as it is the number of hops; where no seed is asked for at two depths, no join deals out the pairs.
    """
    asked = requests.select("seed", "depth").distinct()
    hops, rows, seeds = asked.agg(F.max("depth"), F.count("*"), F.count_distinct("seed")).first()
    hops = max(hops or 0, 1)
    if rows == seeds:
        return _reach(edges, asked, hops)
    deepest = asked.groupBy("seed").agg(F.max("depth").alias("depth"))
    found = reach(edges, deepest, hops)
    return found.join(asked, "seed").where(F.col("distance") <= F.col("depth"))


def directed_edges(catalog: Catalog, direction: str) -> StepEdges:
    """The lineage edges in walking order, prepared once per session."""
    if direction not in ("upstream", "downstream"):
        raise ValueError(f"direction must be upstream or downstream, not {direction!r}")
    key = f"steps_{direction}"
    if key not in catalog.prepared:
        edges = lineage_edges(catalog).select("src", "dst")
        catalog.prepared[key] = step_edges(
            reversed_edges(edges) if direction == "upstream" else edges
        )
    return catalog.prepared[key]


def bfs(catalog: Catalog, requests: DataFrame, direction: str) -> DataFrame:
    """requests(seed, depth) -> (seed, depth, node, distance) in one direction."""
    return reach_within(directed_edges(catalog, direction), requests)


def neighbor_counts(catalog: Catalog) -> DataFrame:
    """Direct parent and child tables of every table, zero where there are none."""
    edges = catalog.table_table_edges
    ends = edges.selectExpr("child_table_id AS table_id", "1 AS parent", "0 AS child").union(
        edges.selectExpr("parent_table_id AS table_id", "0 AS parent", "1 AS child")
    )
    counts = ends.groupBy("table_id").agg(
        F.sum("parent").alias("parent_table_count"), F.sum("child").alias("child_table_count")
    )
    return catalog.tables.select("table_id").join(counts, "table_id", "left").select(
        "table_id",
        F.coalesce("parent_table_count", F.lit(0)).cast("bigint").alias("parent_table_count"),
        F.coalesce("child_table_count", F.lit(0)).cast("bigint").alias("child_table_count"),
    )


def top_nodes(reached: DataFrame, limit: int = TRACE_NODE_LIMIT) -> DataFrame:
    """The first `limit` nodes per request by (distance, node), with their rank."""
    order = Window.partitionBy("seed", "depth").orderBy("distance", "node")
    return reached.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def trace_lineage(catalog: Catalog, requests: DataFrame, direction: str) -> DataFrame:
    """Up to 100 nodes per request with type and name; truncated when more can be reached.

    "Can be reached" has no depth bound: the flag is also set when a node at the asked depth has
    an edge to a node not found within it, which needs one more step, not the full closure.
    """
    steps = directed_edges(catalog, direction)
    edges = steps.edges.select("src", "dst")
    reached = stage(reach_within(steps, requests), "traced")
    key = ["seed", "depth"]
    onward = (
        reached.where(F.col("distance") == F.col("depth"))
        .select(*key, F.col("node").alias("src"))
        .join(edges, "src")
        .select(*key, F.col("dst").alias("node"))
        .distinct()
        .join(reached, [*key, "node"], "left_anti")
        .select(*key).distinct().withColumn("beyond", F.lit(True))
    )
    sizes = reached.groupBy(*key).agg(F.count("*").alias("reachable"))
    nodes = lineage_nodes(catalog).withColumnRenamed("id", "node")
    more = (F.col("reachable") > TRACE_NODE_LIMIT) | F.coalesce("beyond", F.lit(False))
    return (
        top_nodes(reached)
        .join(nodes, "node")
        .join(sizes, key)
        .join(onward, key, "left")
        .select(*key, "node", "type", "name", "distance", "rank", more.alias("truncated"))
    )


def _chains(links: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Nodes with one way in and one way out: (node, before, after) with the ends of the path they lie on,
    and the nodes of paths that close on themselves; None where there are no such nodes.

    Pointers double: after k rounds a node knows the ends of the 2^k steps on each of its sides.
    """
    ins = links.groupBy(F.col("head").alias("node")).agg(
        F.count("*").alias("n_in"), F.min("tail").alias("before")
    )
    outs = links.groupBy(F.col("tail").alias("node")).agg(
        F.count("*").alias("n_out"), F.min("head").alias("after")
    )
    passed = ins.join(outs, "node").where("n_in = 1 AND n_out = 1 AND before <> node")
    jumps = stage(passed.select("node", "before", "after"), "chains")
    size = jumps.count()
    if not size:
        return None
    for _ in range(size.bit_length()):
        onward = jumps.select(F.col("node").alias("after"), F.col("after").alias("_after"))
        back = jumps.select(F.col("node").alias("before"), F.col("before").alias("_before"))
        jumps = stage(
            jumps.join(onward, "after", "left").join(back, "before", "left").select(
                "node", F.coalesce("_before", "before").alias("before"),
                F.coalesce("_after", "after").alias("after"),
                F.col("_after").isNotNull().alias("moved"),
            ),
            "chains",
        )
        if jumps.where("moved").isEmpty():
            break
        jumps = jumps.drop("moved")
    own = jumps.select(F.col("node").alias("after"))
    return jumps.join(own, "after", "left_anti"), jumps.join(own, "after", "left_semi").select("node")


def cyclic_part(edges: DataFrame) -> DataFrame:
    """Edges that have a cycle, or a part of one, both before and behind them; empty for a DAG.

    Each round removes edges that do not go on at both ends, so all edges to reports and metrics
    are gone after the first one. Where that removes less than half, paths without branches are
    drawn together into one link first, by doubling, so a chain of any length costs its logarithm;
    every edge keeps the link it lies on. Rounds are bounded by the longest path that branches at
    every node. Every round's remainder is written once.
    """
    left = stage(
        edges.select("src", "dst").distinct()
        .select("src", "dst", F.col("src").alias("tail"), F.col("dst").alias("head")),
        "peel",
    )
    links = left.count()
    rings = []
    while links:
        parents = left.select(F.col("head").alias("tail")).distinct()
        children = left.select(F.col("tail").alias("head")).distinct()
        left = stage(
            left.join(parents, "tail", "left_semi").join(children, "head", "left_semi"), "peel"
        )
        before, links = links, left.select("tail", "head").distinct().count()
        if not links or 2 * links <= before:
            continue
        chains = _chains(left.select("tail", "head").distinct())
        if chains is None:
            if links == before:
                break
            continue
        ends, closed = chains
        rings.append(
            stage(left.join(closed.withColumnRenamed("node", "tail"), "tail", "left_semi"), "rings")
        )
        heads = ends.select(F.col("node").alias("head"), F.col("after").alias("_head"))
        tails = ends.select(F.col("node").alias("tail"), F.col("before").alias("_tail"))
        left = stage(
            left.join(closed.withColumnRenamed("node", "tail"), "tail", "left_anti")
            .join(tails, "tail", "left").join(heads, "head", "left")
            .select("src", "dst", F.coalesce("_tail", "tail").alias("tail"),
                    F.coalesce("_head", "head").alias("head")),
            "peel",
        )
        links = left.select("tail", "head").distinct().count()
    return reduce(DataFrame.unionByName, rings, left).select("src", "dst")


def witness_cycle(stuck: DataFrame) -> DataFrame:
    """(position, node): one cycle of a cyclic part in the direction of its edges, from its least node on.

    Every node of a cyclic part that can be come to has a lowest parent; going back from parent to
    parent ends in a cycle. Doubled steps find the nodes that are still met after any number of
    steps, then the cycle of the least of them, in rounds that grow with the logarithm of the nodes.
    """
    steps = [
        stage(stuck.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("back")), "back")
    ]

    def twice() -> DataFrame:
        onward = steps[-1].select(F.col("node").alias("back"), F.col("back").alias("_back"))
        return stage(steps[-1].join(onward, "back").select("node", F.col("_back").alias("back")), "back")

    met = steps[0].agg(F.count_distinct("back")).first()[0]
    while met:
        steps.append(twice())
        before, met = met, steps[-1].agg(F.count_distinct("back")).first()[0]
        if met == before:
            break
    ring = steps[-1].agg(F.min("back").alias("node")).where("node IS NOT NULL").withColumn(
        "gone", F.lit(0).cast("bigint")
    )
    power, size = 0, ring.count()
    while size == 2**power:
        if power == len(steps):
            steps.append(twice())
        further = ring.join(steps[power], "node").select(
            F.col("back").alias("node"), (F.col("gone") + 2**power).alias("gone")
        )
        ring = stage(ring.union(further).groupBy("node").agg(F.min("gone").alias("gone")), "ring")
        power, size = power + 1, ring.count()
    return ring.select(((size - F.col("gone")) % max(size, 1)).alias("position"), "node")


def check_dag(edges: DataFrame) -> DataFrame:
    """One row: is it a DAG, how many edges lie on a cycle or between two, the length of one cycle
    and its least node."""
    stuck = stage(cyclic_part(edges), "cyclic")
    cycle = witness_cycle(stuck).agg(
        F.count("*").alias("cycle_length"), F.min("node").alias("witness")
    )
    sizes = stuck.agg(F.count("*").alias("cyclic_edges"))
    one = F.lit(1).alias("one")
    return sizes.select("*", one).join(cycle.select("*", one), "one").select(
        (F.col("cyclic_edges") == 0).alias("is_dag"), "cyclic_edges", "cycle_length", "witness"
    )


def upstream_tables(catalog: Catalog, requests: DataFrame) -> DataFrame:
    """requests(seed, depth) -> tables within depth upstream of a report, metric or table.

    Walks table-only edges; the first hop of a report or metric comes from its link table.
    """
    back = catalog.table_table_edges.selectExpr("child_table_id AS src", "parent_table_id AS dst")
    links = (
        catalog.report_table_edges.selectExpr("report_id AS src", "table_id AS dst")
        .union(metric_sources(catalog).selectExpr("metric_id AS src", "table_id AS dst"))
        .distinct()
    )
    return reach_within(back.union(links), requests)


def downstream_reports(catalog: Catalog, requests: DataFrame) -> DataFrame:
    """requests(seed table, depth) -> reports reading a table within depth - 1 of the seed, with their distance."""
    edges = catalog.table_table_edges.selectExpr("parent_table_id AS src", "child_table_id AS dst")
    steps = requests.select("seed", (F.col("depth") - 1).alias("depth")).distinct()
    tables = reach_within(edges, steps).select("seed", "depth", "node", "distance")
    own = steps.select("seed", "depth", F.col("seed").alias("node"), F.lit(0).alias("distance"))
    readers = catalog.report_table_edges.withColumnRenamed("table_id", "node")
    return (
        tables.union(own).join(readers, "node")
        .groupBy("seed", (F.col("depth") + 1).alias("depth"), "report_id")
        .agg((F.min("distance") + 1).alias("distance"))
    )
