"""Reachability of whole graphs as bitmaps: what a node reaches is one bit a node, not one row a pair.

Nodes get positions in the order of their kinds and ids. A node's reach is one row per kind and
bucket of 32,768 positions, with a bitmap of 4,096 bytes. Bitmaps are merged level by level: what changed on one level is
passed to the parents and united with what they know, until nothing changes, so cycles end as well.
Nodes that nothing leads to pass nothing on: they are met once, in words of 64 positions of which only those
with a bit are rows. Counts, the first and the last reached id come straight from bitmaps and words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.handed_reach import HandedReach, handed_reach, walked_counts
from quarrylight.operators.lineage import StepEdges, reversed_edges, step_edges
from quarrylight.operators.skew import fan_out_hot_keys
from quarrylight.sources.staging import release, stage

#: Positions in one bitmap of Spark's bitmap functions. Fixed value.
BUCKET_BITS = 32_768
BUCKET_BYTES = BUCKET_BITS // 8
#: Nodes that one task orders, on average: a few full buckets, so bitmaps are not spread thin.
RANGE_NODES = 8 * BUCKET_BITS
#: Positions in one word. Fixed value.
WORD_BITS = 64


@dataclass
class ReachBitmaps:
    """nodes(id, kind, position); reach(seed, kind, bucket, bitmap, first, last), with the lowest and the
    highest position of the bitmap, of nodes that something leads to; words(seed, kind, word, bits) of those
    that nothing leads to. A node that reaches nothing has neither."""

    nodes: DataFrame
    reach: DataFrame
    words: DataFrame


def number_nodes(nodes: DataFrame) -> DataFrame:
    """nodes(id, kind) with `position`, ascending with (kind, id), written once.

    Ranges of ids go to a task each, which counts from its own start, so no task orders all nodes; positions
    have gaps between tasks, where no bitmap lies. An id has one kind: of several, the first counts.
    """
    named = nodes.where("id is not null").groupBy("id").agg(F.min("kind").alias("kind"))
    ranges = max(1, -(-named.count() // RANGE_NODES))
    ordered = named.repartitionByRange(ranges, "kind", "id").sortWithinPartitions("kind", "id")
    return stage(ordered.select("id", "kind", F.monotonically_increasing_id().alias("position")), "bitmap-nodes")


def bucket_of(position: Column) -> Column:
    return F.shiftright(position, BUCKET_BITS.bit_length() - 1)


def direct_bitmaps(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seed, kind, bucket, bitmap, first, last): what each node reaches in one step. edges(src, dst)."""
    placed = edges.select("src", "dst").distinct().join(nodes.withColumnRenamed("id", "dst"), "dst")
    return placed.groupBy(F.col("src").alias("seed"), "kind", bucket_of(F.col("position")).alias("bucket")).agg(
        F.bitmap_construct_agg(F.pmod("position", F.lit(BUCKET_BITS)).cast("long")).alias("bitmap"),
        F.min("position").alias("first"), F.max("position").alias("last"),
    )


def united() -> list[Column]:
    """Bitmaps of a group as one."""
    return [F.bitmap_or_agg("bitmap").alias("bitmap"), F.min("first").alias("first"), F.max("last").alias("last")]


def met(parents: StepEdges, reached: DataFrame) -> DataFrame:
    """Rows of reached(seed, ..) with `dst`, a parent of their seed, in place of it; parents walks an edge backwards."""
    at = reached.withColumnRenamed("seed", "src")
    if parents.hubs is not None:
        return fan_out_hot_keys(at, parents.hubs, "src").join(parents.edges, ["src", "salt"])
    return at.join(parents.edges, "src")


def passed_up(parents: StepEdges, changed: DataFrame) -> DataFrame:
    """The bitmaps of changed nodes as bitmaps of their parents."""
    at = changed.select("seed", "kind", "bucket", "bitmap", "first", "last")
    # United here already: a parent of many changed nodes gets one row a task, not one a child.
    return met(parents, at).groupBy(F.col("dst").alias("seed"), "kind", "bucket").agg(*united())


def word_of(position: Column) -> Column:
    return F.shiftright(position, WORD_BITS.bit_length() - 1)


def words_of(bitmaps: DataFrame) -> DataFrame:
    """(seed, kind, word, bits): the words with a bit of bitmaps(seed, kind, bucket, bitmap); bit n is position n of the word."""
    size = WORD_BITS // 8

    def taken(place: Column) -> Column:
        return F.substring("bitmap", place * size + 1, F.lit(size))

    places = F.sequence(F.lit(0), F.lit(BUCKET_BITS // WORD_BITS - 1))
    set_places = F.filter(places, lambda w: taken(w) != F.lit(bytes(size)))
    at = bitmaps.select("seed", "kind", "bucket", "bitmap", F.explode(set_places).alias("place"))
    # A bitmap's bytes ascend, a number's descend.
    hexed = F.hex(taken(F.col("place")))
    digits = F.concat(*[F.substring(hexed, 2 * byte + 1, 2) for byte in range(size - 1, -1, -1)])
    word = F.col("bucket") * (BUCKET_BITS // WORD_BITS) + F.col("place")
    return at.select("seed", "kind", word.alias("word"), F.conv(digits, 16, -10).cast("long").alias("bits"))


def ended_words(outer: StepEdges, reached: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seed, kind, word, bits) of the nodes that nothing leads to: their next nodes and all that those reach."""
    heads = outer.edges.select(F.col("dst").alias("seed"), F.col("src").alias("id"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("position", F.lit(WORD_BITS)).cast("int"))
    direct = heads.join(nodes, "id").select("seed", "kind", word_of(F.col("position")).alias("word"), bit.alias("bits"))
    behind = met(outer, stage(words_of(reached), "reach-words")).select(F.col("dst").alias("seed"), "kind", "word", "bits")
    return direct.unionByName(behind).groupBy("seed", "kind", "word").agg(F.bit_or("bits").alias("bits"))


def reach_bitmaps(edges: DataFrame, nodes: DataFrame | None = None, counts_only: bool = False) -> ReachBitmaps | HandedReach:
    """The full reach of every node of edges(src, dst), itself included only where it lies on a cycle.

    nodes(id, kind) names the nodes' kinds; without it all are of one kind, the empty text. A level is one join
    with the edges and one union by (node, kind, bucket); only bitmaps that gained a bit are
    passed on. Levels are the longest shortest way between two nodes. Each is written once, and the state
    before it is released. Nodes that nothing leads to pass nothing on, so they take no part in the levels: they
    are met in one step from the finished reach of the nodes they lead to. For reach_counts alone (counts_only) no
    bitmap is made where one side of the graph can be handed out; each node's reach is walked then.
    """
    edges = stage(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "bitmap-edges")
    if nodes is None:
        nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("kind", F.lit(""))
    if counts_only:
        walked = handed_reach(edges, nodes)
        if walked is not None:
            return walked
    nodes = number_nodes(nodes)
    parents = step_edges(reversed_edges(edges))
    # A backward edge ends at a node that nothing leads to.
    inner, outer = (StepEdges(parents.edges.where(part), parents.hubs) for part in ("NOT ends", "ends"))
    known = stage(direct_bitmaps(reversed_edges(inner.edges), nodes).withColumn("gained", F.lit(True)), "reach-bitmaps")
    while True:
        changed = known.where("gained")
        if changed.isEmpty():
            break
        both = known.drop("gained").withColumn("before", F.col("bitmap")).unionByName(
            passed_up(inner, changed).withColumn("before", F.lit(None).cast("binary"))
        )
        merged = both.groupBy("seed", "kind", "bucket").agg(*united(), F.max("before").alias("before"))
        gained = ~F.col("bitmap").eqNullSafe(F.col("before"))
        after = stage(merged.withColumn("gained", gained).drop("before"), "reach-bitmaps")
        release(known)
        known = after
    reached = known.drop("gained")
    return ReachBitmaps(nodes, reached, stage(ended_words(outer, reached, nodes), "ended-words"))


def positions_of(bitmap: Column) -> Column:
    """The positions set in a bitmap, ascending: bytes of zeros are skipped first."""
    hexed = F.hex(bitmap)

    def bits(place: Column) -> Column:
        value = F.conv(F.substring(hexed, place * 2 + 1, 2), 16, 10).cast("int")
        inside = F.filter(F.array(*[F.lit(b) for b in range(8)]), lambda b: F.getbit(value, b) == 1)
        return F.transform(inside, lambda b: place * 8 + b)

    places = F.filter(F.sequence(F.lit(0), F.lit(BUCKET_BYTES - 1)), lambda p: F.substring(hexed, p * 2 + 1, 2) != "00")
    return F.flatten(F.transform(places, bits))


def reach_pairs(reached: ReachBitmaps) -> DataFrame:
    """(seed, node) of every bit; only for results that are pairs themselves."""
    bits = reached.reach.select("seed", "kind", "bucket", F.explode(positions_of(F.col("bitmap"))).alias("bit"))
    spread = bits.select("seed", "kind", (F.col("bit") + F.col("bucket") * BUCKET_BITS).alias("position"))
    places = F.filter(F.array(*[F.lit(b) for b in range(WORD_BITS)]), lambda b: F.getbit("bits", b) == 1)
    ended = reached.words.select("seed", "kind", "word", F.explode(places).alias("bit")).select(
        "seed", "kind", (F.col("bit") + F.col("word") * WORD_BITS).alias("position")
    )
    return spread.unionByName(ended).join(reached.nodes, ["kind", "position"]).select("seed", F.col("id").alias("node"))


def reach_counts(reached: ReachBitmaps | HandedReach) -> DataFrame:
    """(seed, kind, n, first_id, last_id) per node and kind it reaches: sums over its bitmaps or words, or of walks; no pairs."""
    if isinstance(reached, HandedReach):
        return walked_counts(reached)
    digits = F.bin("bits")
    lowest = F.col("word") * WORD_BITS + F.length(digits) - F.length(F.rtrim(digits, F.lit("0")))
    highest = F.col("word") * WORD_BITS + F.length(digits) - 1
    parts = reached.reach.select("seed", "kind", F.bitmap_count("bitmap").alias("n"), "first", "last").unionByName(
        reached.words.select(
            "seed", "kind", F.bit_count("bits").cast("long").alias("n"), lowest.alias("first"), highest.alias("last")
        )
    )
    ends = parts.groupBy("seed", "kind").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    first = reached.nodes.select("kind", F.col("position").alias("first"), F.col("id").alias("first_id"))
    last = reached.nodes.select("kind", F.col("position").alias("last"), F.col("id").alias("last_id"))
    return ends.join(first, ["kind", "first"]).join(last, ["kind", "last"]).select("seed", "kind", "n", "first_id", "last_id")
