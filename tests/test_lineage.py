import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tests.conftest import table_id
from quarrylight.operators import gold, lineage


def pairs(df):
    return {(r["seed"], r["node"], r["distance"]) for r in df.collect()}


def brute(edges, seeds, depth=None):
    out = set()
    for seed in seeds:
        seen, frontier, d = {seed}, {seed}, 0
        while frontier and (depth is None or d < depth):
            d += 1
            frontier = {b for a, b in edges if a in frontier} - seen
            seen |= frontier
            out |= {(seed, n, d) for n in frontier}
    return out


def graph(spark, cyclic):
    rng = random.Random(7)
    edges = set()
    for _ in range(90):
        a, b = rng.randrange(30), rng.randrange(30)
        if a != b:
            edges.add((a, b) if cyclic else (min(a, b), max(a, b)))
    edges |= {(0, n) for n in range(1, 25)}  # a hub
    named = [(f"n{a:02d}", f"n{b:02d}") for a, b in sorted(edges)]
    return named, spark.createDataFrame(named, "src string, dst string")


@pytest.mark.parametrize("cyclic", [False, True])
@pytest.mark.parametrize("hops", [1, 3])
def test_reach_matches_brute_force(spark, cyclic, hops):
    named, edges = graph(spark, cyclic)
    nodes = sorted({n for e in named for n in e})
    seeds = spark.createDataFrame([(n,) for n in nodes], "seed string")
    assert pairs(lineage.reach(edges, seeds, hops_per_round=hops)) == brute(named, nodes)


def test_reach_with_split_hubs(spark, monkeypatch):
    named, edges = graph(spark, True)
    whole = lineage.split_hot_keys
    monkeypatch.setattr(lineage, "split_hot_keys", lambda df, key, by: whole(df, key, by, hot_rows=5))
    seeds = spark.createDataFrame([("n00",), ("n05",)], "seed string")
    assert pairs(lineage.reach(edges, seeds, 3)) == brute(named, ["n00", "n05"], 3)


def test_depth_is_kept_per_request(spark):
    named, edges = graph(spark, False)
    asked = spark.createDataFrame([("n01", 1), ("n01", 4), ("n02", 2)], "seed string, depth int")
    got = {(r["seed"], r["depth"], r["node"], r["distance"]) for r in lineage.reach_within(edges, asked).collect()}
    expected = {(s, d, n, k) for s, d in (("n01", 1), ("n01", 4), ("n02", 2)) for _, n, k in brute(named, [s], d)}
    assert got == expected


def test_mini_closure_and_counts(mini):
    got = {(r["seed"], r["node"]) for r in lineage.table_closure(mini).collect()}
    assert {n for s, n in got if s == table_id(4)} == {table_id(5), table_id(6)}
    assert {n for s, n in got if s == table_id(1)} == {table_id(n) for n in (3, 4, 5, 6, 7)}
    counts = {r["table_id"]: r for r in lineage.neighbor_counts(mini).collect()}
    assert counts[table_id(4)]["parent_table_count"] == 2
    assert counts[table_id(4)]["child_table_count"] == 2
    assert counts[table_id(8)]["child_table_count"] == 0


def test_trace_flags_what_lies_beyond(spark, mini):
    asked = spark.createDataFrame([(table_id(1), 1), (table_id(1), 4), (table_id(4), 2)], "seed string, depth int")
    got = {(r["seed"], r["depth"]): r["truncated"] for r in lineage.trace_lineage(mini, asked, "downstream").collect()}
    assert got == {(table_id(1), 1): True, (table_id(1), 4): False, (table_id(4), 2): False}


def test_upstream_and_downstream_of_the_mini_catalog(spark, mini):
    up = spark.createDataFrame([("RPT-0007", 2), ("MET-002", 1)], "seed string, depth int")
    got = {(r["seed"], r["node"]) for r in lineage.upstream_tables(mini, up).collect()}
    assert got == {("RPT-0007", table_id(n)) for n in (2, 3, 4)} | {("MET-002", table_id(n)) for n in (5, 6)}
    down = spark.createDataFrame([(table_id(4), 1), (table_id(3), 2)], "seed string, depth int")
    found = {(r["seed"], r["report_id"]) for r in lineage.downstream_reports(mini, down).collect()}
    assert {r for s, r in found if s == table_id(4)} == {"RPT-0007"}
    assert {r for s, r in found if s == table_id(3)} == {f"RPT-{n:04d}" for n in (1, 2, 6, 7)}


def test_dag_check_finds_a_cycle(spark, mini):
    assert lineage.check_dag(lineage.lineage_edges(mini)).first()["is_dag"]
    cyclic = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "a")], "src string, dst string")
    row = lineage.check_dag(cyclic).first()
    assert not row["is_dag"] and row["cyclic_edges"] == 2 and row["cycle_length"] == 2 and row["witness"] == "b"


def brute_cyclic(named):
    """Edges left when edges without an edge before or behind them are removed until none is left to remove."""
    left = set(named)
    while True:
        tails, heads = {a for a, _ in left}, {b for _, b in left}
        kept = {(a, b) for a, b in left if a in heads and b in tails}
        if kept == left:
            return left
        left = kept


def check_cycle(cycle, named):
    """The positions are 0 .. n-1, each node leads to the next one and the last one to the first."""
    walk = [r["node"] for r in sorted(cycle.collect(), key=lambda r: r["position"])]
    assert [r["position"] for r in sorted(cycle.collect(), key=lambda r: r["position"])] == list(range(len(walk)))
    assert len(set(walk)) == len(walk) and walk[0] == min(walk)
    assert all((a, b) in named for a, b in zip(walk, walk[1:] + walk[:1]))
    return walk


@pytest.mark.parametrize("seed", range(6))
def test_cyclic_part_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    named = {(f"n{rng.randrange(40):02d}", f"n{rng.randrange(40):02d}") for _ in range(rng.choice([30, 45, 60]))}
    named |= {(f"c{i:02d}", f"c{i + 1:02d}") for i in range(12)}  # a long path
    named |= {(f"r{i}", f"r{(i + 1) % 5}") for i in range(seed % 2 * 5)}  # a ring apart
    named |= {("s", "s")} if seed % 3 == 0 else set()  # an edge to itself
    edges = spark.createDataFrame(sorted(named), "src string, dst string")
    stuck = lineage.cyclic_part(edges)
    expected = brute_cyclic(named)
    assert sorted(map(tuple, stuck.collect())) == sorted(expected)
    if expected:
        check_cycle(lineage.witness_cycle(stuck), expected)


def test_a_chain_and_a_long_ring_take_few_rounds(spark, monkeypatch):
    written = []
    whole = lineage.stage
    monkeypatch.setattr(lineage, "stage", lambda df, name: written.append(name) or whole(df, name))
    chain = spark.range(10_000).selectExpr("id AS src", "id + 1 AS dst")
    row = lineage.check_dag(chain).first()
    assert row["is_dag"] and row["witness"] is None and row["cycle_length"] == 0
    assert len(written) < 30
    written.clear()
    ring = chain.union(spark.sql("SELECT 10000 AS src, 7 AS dst"))
    row = lineage.check_dag(ring).first()
    assert not row["is_dag"] and row["cyclic_edges"] == row["cycle_length"] == 9_994 and row["witness"] == 7
    assert len(written) < 80


def test_an_empty_graph_is_a_dag(spark):
    row = lineage.check_dag(spark.createDataFrame([], "src string, dst string")).first()
    assert row["is_dag"] and row["cyclic_edges"] == 0 and row["witness"] is None


def test_directions_are_checked(mini):
    with pytest.raises(ValueError):
        lineage.directed_edges(mini, "sideways")


def test_walk_plans_have_no_pairwise_join(spark):
    _, edges = graph(spark, False)
    seeds = edges.select(F.col("src").alias("seed"))
    plan = lineage.reach(edges, seeds, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_walks_as_deep_as_asked(spark):
    named = [(f"n{i}", f"n{i + 1}") for i in range(9)]
    edges = spark.createDataFrame(named, "src string, dst string")
    requests = spark.createDataFrame([("n0", 8), ("n3", 1), ("n4", 0)], "seed string, depth int")
    found = {(r.seed, r.depth, r.node, r.distance) for r in lineage.reach_within(edges, requests).collect()}
    assert found == {("n0", 8, f"n{i}", i) for i in range(1, 9)} | {("n3", 1, "n4", 1)}


def test_cards_list_what_fits(spark, mini):
    from dataclasses import replace

    from quarrylight.config import OUTPUT_CHARS
    from quarrylight.operators import tools

    many = spark.range(1, 1001).selectExpr("format_string('TBL-%04d', id) AS table_id", "'t' AS name", "'mart' AS layer")
    links = many.selectExpr("'RPT-0001' AS report_id", "table_id").union(many.limit(3).selectExpr("'RPT-0002'", "table_id"))
    card = {r.report_id: r for r in tools.linked_tables(replace(mini, tables=many), links, "report_id").collect()}
    assert card["RPT-0001"].linked_count == 1000 and card["RPT-0001"].truncated
    size = len('{"id":"TBL-0001","name":"t","layer":"mart"}') + 1
    assert len(card["RPT-0001"].tables) == OUTPUT_CHARS // size
    assert (card["RPT-0002"].linked_count, len(card["RPT-0002"].tables), card["RPT-0002"].truncated) == (3, 3, False)


def test_fixed_depth_baseline_walks_as_deep_as_asked(spark):
    back = spark.createDataFrame(
        [(table_id(n), table_id(n - 1)) for n in range(1, 12)], "src string, dst string"
    )
    chain = SimpleNamespace(prepared={"steps_upstream": lineage.step_edges(back)})
    asked = spark.createDataFrame([(table_id(11), 8), (table_id(11), 2), (table_id(4), 9)], "seed string, depth int")
    got = {(r["item_id"], r["depth"]): (r["n_gold"], r["n_given"]) for r in gold.default_depth_baseline(chain, asked).collect()}
    assert got == {(table_id(11), 8): (8, 3), (table_id(11), 2): (2, 3), (table_id(4), 9): (4, 3)}
    none = gold.default_depth_baseline(chain, asked.limit(0))
    assert none.collect() == []


@pytest.mark.parametrize("hot", [False, True])
def test_ends_of_a_graph_are_met_in_one_step(spark, monkeypatch, hot):
    """Leaves are not walked on from, and seeds that nothing leads to share the walk of what they come to."""
    written = {}
    whole, split = lineage.stage, lineage.split_hot_keys
    monkeypatch.setattr(lineage, "stage", lambda df, name: written.setdefault(name, whole(df, name)))
    if hot:
        monkeypatch.setattr(lineage, "split_hot_keys", lambda df, key, by: split(df, key, by, hot_rows=3))
    named = [(f"top{i}", f"mid{i % 2}") for i in range(9)] + [("top0", "leaf0"), ("mid0", "mid1"), ("mid1", "mid2"), ("mid2", "mid0")]
    named += [(f"mid{i % 3}", f"leaf{i}") for i in range(20)]
    depths = {f"top{i}": i % 5 for i in range(9)} | {"mid0": 2, "mid1": 1, "leaf3": 4, "none": 2}
    edges = spark.createDataFrame(named, "src string, dst string")
    asked = spark.createDataFrame(list(depths.items()), "seed string, depth int")
    got = {(r["seed"], r["depth"], r["node"], r["distance"]) for r in lineage.reach_within(edges, asked).collect()}
    assert got == {(s, d, n, k) for s, d in depths.items() for _, n, k in brute(named, [s], d)}
    walked = {(r["seed"], r["node"]) for r in written["walked"].where("distance > 0").collect()}
    assert walked and {name[:3] for pair in walked for name in pair} == {"mid"}
