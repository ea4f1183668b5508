"""Ranking metrics, signal thresholds and the choice between models.

records: one row per (query, mode) with target_rank, other_rank, topic_hit, pair_covered, type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Threshold grids and the margins of the model choice.
TAU_GRID = [round(0.30 + 0.05 * i, 2) for i in range(9)]
TAU_Z_GRID = [round(0.50 + 0.25 * i, 2) for i in range(23)]
MRR_MARGIN = 0.02
F1_MARGIN = 0.005
PLATEAU = 1e-9


def rank_of_target(hits: DataFrame, items: DataFrame) -> DataFrame:
    """hits(query_id, mode, doc_id, rank), items(query_id, target, other, type, topic) -> records.

    target_rank and other_rank are NULL when the document was not returned.
    """
    modes = hits.select("query_id", "mode").distinct()
    ranks = hits.join(items.select("query_id", "target", "other"), "query_id").groupBy(
        "query_id", "mode"
    ).agg(
        F.min(F.when(F.col("doc_id") == F.col("target"), F.col("rank"))).alias("target_rank"),
        F.min(F.when(F.col("doc_id") == F.col("other"), F.col("rank"))).alias("other_rank"),
    )
    return items.join(modes, "query_id").join(ranks, ["query_id", "mode"], "left")


def topic_hits(hits: DataFrame, items: DataFrame, topics: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, mode) -> does the top k hold a document of the target's topic?

    topics(doc_id, topic).
    """
    wanted = items.join(topics.select(F.col("doc_id").alias("target"), F.col("topic").alias("wanted")),
                        "target").select("query_id", "wanted")
    top = hits.where(F.col("rank") <= k).join(topics, "doc_id", "left")
    return top.join(wanted, "query_id").groupBy("query_id", "mode").agg(
        F.coalesce(F.bool_or(F.col("topic") == F.col("wanted")), F.lit(False)).alias("topic_hit")
    )


def recall_at(k: int, rank: str = "target_rank") -> Column:
    """Share of records whose target is among the first k; a miss counts as not."""
    return F.avg(F.coalesce(F.col(rank) <= k, F.lit(False)).cast("int"))


def mean_reciprocal_rank(rank: str = "target_rank") -> Column:
    """Mean of 1 / rank, 0 for a miss."""
    return F.avg(F.coalesce(F.lit(1.0) / F.col(rank), F.lit(0.0)))


def pair_covered(k: int = 5) -> Column:
    """Both members of a pair are among the first k."""
    return F.coalesce(F.col("target_rank") <= k, F.lit(False)) & F.coalesce(
        F.col("other_rank") <= k, F.lit(False)
    )


def forbidden_first() -> Column:
    """The other member of the pair is ranked before the target, or the target is missing."""
    return F.col("other_rank").isNotNull() & (
        F.col("target_rank").isNull() | (F.col("other_rank") < F.col("target_rank"))
    )


def bench_summary(records: DataFrame) -> DataFrame:
    """Per mode and type (and all ranked types together): n, recall, MRR and the extras."""
    ranked = records.where("type IN ('E', 'P', 'D')")
    return ranked.groupingSets([["mode", "type"], ["mode"]], "mode", "type").agg(
        F.count("*").alias("n"), recall_at(1).alias("recall_1"), recall_at(5).alias("recall_5"),
        mean_reciprocal_rank().alias("mrr"),
        F.avg(F.col("topic_hit").cast("int")).alias("topic_hit_5"),
        F.avg(pair_covered().cast("int")).alias("pair_coverage_5"),
        F.avg(forbidden_first().cast("int")).alias("forbidden_above_target"),
    ).withColumn("type", F.coalesce("type", F.lit("all")))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp > 0, F.lit(2) * tp / (F.lit(2) * tp + fp + fn)).otherwise(F.lit(0.0))


def macro_f1(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """records(truth, predicted) booleans for strong -> mean F1 of strong and weak."""
    t, p = F.col("truth"), F.col("predicted")
    counts = records.groupBy(*(by or [])).agg(
        F.count_if(t & p).alias("ss"), F.count_if(~t & p).alias("ws"),
        F.count_if(t & ~p).alias("sw"), F.count_if(~t & ~p).alias("ww"),
    )
    return counts.select(*(by or []), _macro().alias("macro_f1"))


def _macro() -> Column:
    ss, ws, sw, ww = F.col("ss"), F.col("ws"), F.col("sw"), F.col("ww")
    return (_f1(ss, ws, sw) + _f1(ww, sw, ws)) / F.lit(2.0)


def threshold_sweep(records: DataFrame, value: str, grid: list[float]) -> DataFrame:
    """records(truth, exact_match, value) -> per threshold: macro-F1 and the rates of both classes.

    Every record is put once into the highest threshold it passes (exact matches pass all), so
    the records are read once and counted into at most len(grid) + 1 rows before the grid is
    unfolded.
    """
    taus = F.array(*[F.lit(float(t)) for t in grid])
    passed = F.when(F.col("exact_match"), len(grid)).otherwise(
        F.size(F.filter(taus, lambda t: t <= F.col(value)))
    )
    buckets = records.groupBy(F.col("truth"), passed.alias("passed")).agg(F.count("*").alias("n"))
    unfolded = buckets.select("truth", "passed", "n", F.posexplode(taus).alias("i", "tau"))
    strong = F.col("passed") > F.col("i")

    def total(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))

    truth = F.col("truth")
    counts = unfolded.groupBy("tau").agg(
        total(truth & strong).alias("ss"), total(~truth & strong).alias("ws"),
        total(truth & ~strong).alias("sw"), total(~truth & ~strong).alias("ww"),
    )
    return counts.select(
        "tau", _macro().alias("macro_f1"),
        F.coalesce(F.col("ss") / F.nullif(F.col("ss") + F.col("sw"), F.lit(0)), F.lit(0.0))
        .alias("strong_rate_positive"),
        F.coalesce(F.col("ww") / F.nullif(F.col("ww") + F.col("ws"), F.lit(0)), F.lit(0.0))
        .alias("weak_rate_negative"),
    )


def choose_tau(sweep: DataFrame) -> DataFrame:
    """The lower middle threshold of the plateau of best macro-F1 (four digits)."""
    rounded = sweep.select("tau", F.round("macro_f1", 4).alias("macro_f1"))
    best = rounded.agg(F.max("macro_f1")).scalar()
    tied = rounded.where(F.col("macro_f1") > best - PLATEAU)
    # A sweep has one row per threshold of a short grid.
    taus = tied.agg(F.array_sort(F.collect_list("tau")).alias("taus"), F.max("macro_f1").alias("macro_f1"))
    middle = F.floor((F.size("taus") - 1) / 2).cast("int") + 1
    return taus.select(F.element_at("taus", middle).alias("tau"), "macro_f1")


def choose_signal(cosine_sweep: DataFrame, z_sweep: DataFrame) -> DataFrame:
    """kind, threshold and macro-F1; z wins only when strictly better."""
    cosine, z = choose_tau(cosine_sweep), choose_tau(z_sweep)
    both = cosine.select(
        F.col("tau").alias("c_tau"), F.col("macro_f1").alias("c_f1"),
        z.select("tau").scalar().alias("z_tau"), z.select("macro_f1").scalar().alias("z_f1"),
    )
    better = F.col("z_f1") > F.col("c_f1") + PLATEAU
    return both.select(
        F.when(better, "z").otherwise("cosine").alias("kind"),
        F.when(better, F.col("z_tau")).otherwise(F.col("c_tau")).alias("threshold"),
        F.when(better, F.col("z_f1")).otherwise(F.col("c_f1")).alias("macro_f1"),
    )


def signal_equals_exact(records: DataFrame, value: str, threshold: float) -> DataFrame:
    """True when no record without an exact match reaches the threshold."""
    above = ~F.col("exact_match") & (F.col(value) >= threshold)
    return records.agg((~F.coalesce(F.bool_or(above), F.lit(False))).alias("only_exact"))


def signal_extras(records: DataFrame, value: str, threshold: float) -> DataFrame:
    """Records of type P and N called strong without an exact match."""
    above = ~F.col("exact_match") & (F.col(value) >= threshold)
    return records.where("type IN ('P', 'N')").groupBy("type").agg(F.count_if(above).alias("extras"))


def choose_model(runs: DataFrame, incumbent: str) -> DataFrame:
    """runs(model, mrr, macro_f1) -> the model the pairwise rule ends on.

    In name order each model meets the best so far: an MRR gap of 0.02 decides, otherwise it
    must gain 0.005 macro-F1. The incumbent starts, or the first name when it did not run.
    """
    # One row per model that ran; the fold needs them in name order.
    ordered = runs.agg(
        F.array_sort(F.collect_list(F.struct("model", "mrr", "macro_f1"))).alias("runs")
    )
    start = F.coalesce(
        F.filter("runs", lambda r: r["model"] == incumbent)[0], F.element_at("runs", 1)
    )

    def meet(best: Column, run: Column) -> Column:
        gap = run["mrr"] - best["mrr"]
        better = F.when(F.abs(gap) >= MRR_MARGIN, gap > 0).otherwise(
            run["macro_f1"] - best["macro_f1"] >= F1_MARGIN
        )
        return F.when((run["model"] != best["model"]) & better, run).otherwise(best)

    return ordered.select(F.aggregate("runs", start, meet)["model"].alias("model"))


def leakage_stats(paraphrases: DataFrame, limit: float = 0.20) -> DataFrame:
    """paraphrases(overlap) -> mean overlap with the target's text and how many exceed the limit."""
    return paraphrases.agg(
        F.avg("overlap").alias("mean_overlap"), F.count_if(F.col("overlap") > limit).alias("over_limit"),
        F.count("*").alias("n"),
    )


def before_after(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two bench summaries side by side, with the change."""
    measures = ["recall_1", "recall_5", "mrr"]
    old = first.select("mode", "type", *[F.col(m).alias(f"{m}_before") for m in measures])
    new = second.select("mode", "type", *[F.col(m).alias(f"{m}_after") for m in measures])
    joined = old.join(new, ["mode", "type"], "full")
    return joined.select(
        "*", *[(F.col(f"{m}_after") - F.col(f"{m}_before")).alias(f"{m}_change") for m in measures]
    )

