"""Mixing sources to target weights: tempered shares, realised by permuted blocks within a budget.

Shares of tokens are raised to an exponent and normalised. Exponent 1 keeps the shares, 0 makes them equal;
it is bisected, either to reach a target entropy of the weights (in parts of the largest possible) or so
that no source is repeated more than `max_repeats` times as often as the least repeated one. The budget
defaults to the smallest that shows every document once.

Each source's tokens are then dealt out over epochs: whole passes first, and in the last pass blocks of
documents in a permuted order until the source's budget is reached; the block at the border is taken
document by document. Blocks are hash buckets of about `BLOCK_DOCS` documents, so the running sums are
over few rows and a source that holds most of the corpus is never gathered.

Nulls: a null source is a source of its own, a null text has no tokens and costs nothing; a source without
tokens is kept once. Repeated rows are all kept. Empty tables give empty results. Columns of `docs` come
back as they are, in the struct `row`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.tables import text_of
from quarrylight.sources.staging import stage

BLOCK_DOCS = 2048
MAX_REPEATS = 2.0
STEPS = 60


def tempered(shares: dict, exponent: float) -> dict:
    raised = {s: p**exponent for s, p in shares.items() if p > 0}
    total = sum(raised.values())
    return {s: v / total for s, v in raised.items()}


def entropy(weights: dict) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def repeats(shares: dict, weights: dict) -> float:
    """How often the most repeated source is seen for each time of the least repeated one."""
    ratios = [w / shares[s] for s, w in weights.items()]
    return max(ratios, default=1.0) / min(ratios, default=1.0)


def solve_exponent(shares: dict, target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS) -> float:
    """The smallest exponent in [0, 1], flattest mix, that the entropy target and the repetition limit allow.

    `target_entropy` is a part of log(sources) not to be exceeded. Both measures fall as the exponent rises.
    """

    def allowed(exponent: float) -> bool:
        weights = tempered(shares, exponent)
        most = math.log(len(weights)) if len(weights) > 1 else 0.0
        if target_entropy is not None and entropy(weights) > target_entropy * most + 1e-12:
            return False
        return max_repeats is None or repeats(shares, weights) <= max_repeats + 1e-12

    if allowed(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if allowed(middle) else (middle, high)
    return high


def n_tokens(text: Column) -> Column:
    """Words, as the measure of a document's tokens: characters that start a run of non-white ones."""
    return F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def order_key(*columns: Column, seed: int) -> Column:
    return F.xxhash64(*columns, F.lit(seed))


def mix_sources(
    docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text",
    target_entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: int | None = None,
    seed: int = 17,
) -> DataFrame:
    """Rows (row, source, n_tokens, weight, epoch, position): every document as often as its source's
    weight asks; `epoch` counts from 0 and `position` (a hash) orders the mix within an epoch.

    The driver sees one row per source. `budget` is in tokens; with less than a source holds, the part of
    it in permuted order is taken.
    """
    spark = docs.sparkSession
    text = text_of(text_column)
    own = F.xxhash64(F.col(id_column), text)
    sized = docs.select(
        F.struct("*").alias("row"), F.col(source_column).alias("source"), n_tokens(text).alias("n_tokens"), own.alias("key")
    )
    light = stage(sized.select("source", "n_tokens", "key"), "mix-sizes")
    totals = light.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).collect()
    corpus = sum(r.n for r in totals)
    shares = {r.source: r.n / corpus for r in totals if r.n} if corpus else {}
    weights = tempered(shares, solve_exponent(shares, target_entropy, max_repeats)) if shares else {}
    least = min((weights[s] / shares[s] for s in weights), default=1.0)
    tokens = budget if budget is not None else (corpus / least if corpus else 0)
    plan = []
    for r in totals:
        asked = tokens * weights.get(r.source, 0.0)
        passes = round(asked / r.n, 9) if r.n else 1.0
        whole = int(passes)
        plan.append((
            r.source, float(weights.get(r.source, 0.0)), whole, round((passes - whole) * r.n), max(1, -(-r.rows // BLOCK_DOCS))
        ))
    # One row per source.
    sources = spark.createDataFrame(
        plan, f"source {docs.schema[source_column].dataType.simpleString()}, weight double, passes int, rest long, blocks int"
    )
    sources = F.broadcast(sources)

    def with_plan(df: DataFrame) -> DataFrame:
        named = sources.select(F.col("source").alias("_source"), "weight", "passes", "rest", "blocks")
        return df.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn(
            "block", F.pmod("key", "blocks")
        )

    # The last pass: blocks in permuted order, running sums over blocks, then inside the border block.
    sizes = with_plan(light).where("rest > 0").groupBy("source", "rest", "block").agg(F.sum("n_tokens").alias("n"))
    turn = Window.partitionBy("source").orderBy(order_key(F.col("source"), F.col("block"), seed=seed), "block")
    ranked = sizes.withColumn("before", F.sum("n").over(turn) - F.col("n"))
    taken = stage(
        ranked.where("before < rest").select(
            "source", "block", (F.col("rest") - F.col("before")).alias("room"), (F.col("before") + F.col("n") <= F.col("rest")).alias("full")
        ),
        "mix-blocks",
    )
    border = taken.where("not full").select(F.col("source").alias("_source"), F.col("block").alias("_block"), "room")
    inside = with_plan(light).join(
        F.broadcast(border), F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))
    ).groupBy("source", "block", "room", "key").agg(F.sum("n_tokens").alias("n"))
    within = Window.partitionBy("source", "block").orderBy(order_key(F.col("key"), seed=seed), "key")
    last = inside.withColumn("upto", F.sum("n").over(within)).where("upto <= room").groupBy("source").agg(
        F.max(F.struct(order_key(F.col("key"), seed=seed), "key")).alias("edge")
    )
    # Per source: the order key up to which the border block's documents are taken; one row per source.
    edges = F.broadcast(last.select(F.col("source").alias("_source"), "edge"))
    # Which blocks of a source are in the last pass follows from the order of blocks: one edge per source.
    block_edges = taken.groupBy("source").agg(
        F.max(F.struct(order_key(F.col("source"), F.col("block"), seed=seed).alias("o"), F.col("block").cast("long").alias("b"))).alias("last"),
        F.max(F.when(~F.col("full"), F.struct(order_key(F.col("source"), F.col("block"), seed=seed).alias("o"), F.col("block").cast("long").alias("b")))).alias("border"),
    )
    block_edges = F.broadcast(block_edges.select(F.col("source").alias("_source"), "last", "border"))
    joined = with_plan(sized).join(block_edges, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    joined = joined.join(edges, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    mine = F.struct(order_key(F.col("source"), F.col("block"), seed=seed).alias("o"), F.col("block").cast("long").alias("b"))
    in_block = (mine <= F.col("last")) & ((mine != F.col("border")) | F.col("border").isNull())
    at_border = (mine == F.col("border")) & (
        F.struct(order_key(F.col("key"), seed=seed), F.col("key")) <= F.col("edge")
    )
    extra = F.coalesce(in_block, F.lit(False)) | F.coalesce(at_border, F.lit(False))
    copies = F.col("passes") + F.when(extra, 1).otherwise(0)
    return (
        joined.withColumn("copies", copies).where("copies > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .select("row", "source", "n_tokens", "weight", "epoch", order_key(F.col("key"), F.col("epoch"), seed=seed).alias("position"))
    )
