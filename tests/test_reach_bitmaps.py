"""Whole-graph reach as bitmaps against a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import reach_bitmaps as bitmaps


def brute_reach(edges):
    onward = {}
    for a, b in edges:
        onward.setdefault(a, set()).add(b)
    found = {}
    for seed in onward:
        seen, todo = set(), list(onward[seed])
        while todo:
            node = todo.pop()
            if node not in seen:
                seen.add(node)
                todo.extend(onward.get(node, ()))
        found[seed] = seen
    return found


def graphs():
    rnd = random.Random(2)
    layered = [(f"n{rnd.randint(0, 40):03d}", f"n{rnd.randint(41, 90):03d}") for _ in range(80)]
    layered += [(f"n{rnd.randint(41, 90):03d}", f"n{rnd.randint(91, 140):03d}") for _ in range(80)]
    cyclic = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "a"), ("x", "a")]
    hub = [("hub", f"leaf{k:04d}") for k in range(300)] + [(f"top{k:03d}", "hub") for k in range(40)]
    return {"layered": layered, "cyclic": cyclic, "hub": hub, "one": [("p", "q")]}


@pytest.mark.parametrize("name", list(graphs()))
def test_bitmaps_equal_a_plain_walk(spark, name):
    edges = graphs()[name]
    expected = brute_reach(edges)
    reached = bitmaps.reach_bitmaps(spark.createDataFrame(edges, "src string, dst string"))
    pairs = {(r.seed, r.node) for r in bitmaps.reach_pairs(reached).collect()}
    assert pairs == {(s, n) for s, nodes in expected.items() for n in nodes}
    counts = {r.seed: (r.n, r.first_id, r.last_id) for r in bitmaps.reach_counts(reached).collect()}
    assert counts == {s: (len(n), min(n), max(n)) for s, n in expected.items()}


def test_kinds_are_counted_apart_and_empty_graphs_reach_nothing(spark):
    edges = spark.createDataFrame([("T1", "T2"), ("T2", "R1"), ("T2", "R2"), (None, "T1")], "src string, dst string")
    kinds = spark.createDataFrame([("T1", "table"), ("T2", "table"), ("R1", "report"), ("R2", "report")], "id string, kind string")
    rows = bitmaps.reach_counts(bitmaps.reach_bitmaps(edges, kinds)).collect()
    assert {(r.seed, r.kind): (r.n, r.first_id, r.last_id) for r in rows} == {
        ("T1", "table"): (1, "T2", "T2"), ("T1", "report"): (2, "R1", "R2"), ("T2", "report"): (2, "R1", "R2")}
    assert bitmaps.reach_counts(bitmaps.reach_bitmaps(edges.limit(0))).count() == 0


def test_positions_cross_bytes_and_buckets(spark):
    n = bitmaps.BUCKET_BITS
    wanted = [0, 7, 8, 4095, n - 1, n, n + 9, 2 * n + 5]
    rows = spark.createDataFrame([(p,) for p in wanted], "position long")
    packed = rows.groupBy(bitmaps.bucket_of(F.col("position")).alias("bucket")).agg(
        F.bitmap_construct_agg(F.pmod("position", F.lit(n)).cast("long")).alias("bitmap"))
    got = packed.select("bucket", bitmaps.positions_of(F.col("bitmap")).alias("all")).collect()
    assert sorted(r.bucket * n + p for r in got for p in r["all"]) == wanted


def test_nodes_nothing_leads_to_take_no_part_in_the_levels(spark, monkeypatch):
    """A chain walked level by level under many starts: the levels hold the chain's bitmaps alone, the starts come once."""
    chain = [(f"n{k:02d}", f"n{k + 1:02d}") for k in range(6)]
    starts = [(f"s{k:03d}", f"n{k % 6:02d}") for k in range(200)] + [("s000", f"n{k:02d}") for k in range(6)]
    written, stage = [], bitmaps.stage

    def noted(df, name):
        written.append((name, staged := stage(df, name)))
        return staged

    monkeypatch.setattr(bitmaps, "stage", noted)
    monkeypatch.setattr(bitmaps, "release", lambda *staged: None)
    reached = bitmaps.reach_bitmaps(spark.createDataFrame(chain + starts, "src string, dst string"))
    levels = [df for name, df in written if name == "reach-bitmaps"]
    assert len(levels) > 3 and all(df.where("seed like 's%'").isEmpty() for df in levels)
    expected = brute_reach(chain + starts)
    counts = {r.seed: (r.n, r.first_id, r.last_id) for r in bitmaps.reach_counts(reached).collect()}
    assert counts == {s: (len(n), min(n), max(n)) for s, n in expected.items()}


def test_words_hold_every_bit_of_a_bitmap(spark):
    n = bitmaps.BUCKET_BITS
    wanted = [0, 1, 63, 64, 127, 4095, n - 1, n, n + 63, 2 * n + 5]
    rows = spark.createDataFrame([("s", "", p) for p in wanted], "seed string, kind string, position long")
    packed = rows.groupBy("seed", "kind", bitmaps.bucket_of(F.col("position")).alias("bucket")).agg(
        F.bitmap_construct_agg(F.pmod("position", F.lit(n)).cast("long")).alias("bitmap"))
    got = bitmaps.words_of(packed).collect()
    assert sorted(r.word * 64 + b for r in got for b in range(64) if (r.bits >> b) & 1) == wanted


@pytest.mark.parametrize("name", list(graphs()))
@pytest.mark.parametrize("back", [False, True])
def test_counts_are_walked_where_a_side_is_handed_out(spark, monkeypatch, name, back):
    """The same counts without a bitmap: forward, and back where the other side is the small one."""
    from quarrylight.operators import handed_reach

    edges = graphs()[name]
    expected = brute_reach(edges)
    ends = {n for nodes in expected.values() for n in nodes}
    kinds = spark.createDataFrame([(n, "odd" if int(n[-1:], 36) % 2 else None) for n in sorted(ends)], "id string, kind string")
    monkeypatch.setattr(bitmaps, "direct_bitmaps", None)
    hand_out, calls = handed_reach.hand_out, []
    monkeypatch.setattr(handed_reach, "hand_out", lambda *a: None if back and not calls and not calls.append(1) else hand_out(*a))
    reached = bitmaps.reach_bitmaps(spark.createDataFrame(edges, "src string, dst string"), kinds, counts_only=True)
    assert reached.forward is not back
    # Nodes of no kind are passed, not counted.
    odd = {seed: [n for n in nodes if int(n[-1:], 36) % 2] for seed, nodes in expected.items()}
    wanted = {(seed, "odd"): (len(some), min(some), max(some)) for seed, some in odd.items() if some}
    assert {(r.seed, r.kind): (r.n, r.first_id, r.last_id) for r in bitmaps.reach_counts(reached).collect()} == wanted
