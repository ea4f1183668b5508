"""Audits of run files: identities, names, duplicates, stored scores, quota, replays, texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.scalars import link_kind, markdown_links, secret_kinds
from quarrylight.operators.runs import KEY, llm_calls, requests_spent
from quarrylight.operators.scoring import score_answers

# The shape of a run file's name and the tolerance of calls over requests.
FILE_NAME = r"^test_(A[0-9])_r([0-9]+)\.jsonl$"
REPLAY_ALLOWANCE = 1.10
REPLAY_SLACK = 10
RATE_FLOOR = 0.5
IDENTITY = ["model", "api_version", "prompt_version", "frozen_tree_hash"]


def mixed_identities(lines: DataFrame) -> DataFrame:
    """Files whose lines were written by more than one (model, api, prompt, tree)."""
    return lines.groupBy("file_name").agg(
        F.count_distinct(F.struct(*IDENTITY)).alias("identities")
    ).where("identities > 1")


def misfiled_lines(lines: DataFrame) -> DataFrame:
    """Lines in a file with a bad name, or with another configuration or repeat than its name."""
    config = F.regexp_extract("file_name", FILE_NAME, 1)
    repeat = F.regexp_extract("file_name", FILE_NAME, 2)
    problem = F.when(config == "", "not a run file name").when(
        (config != F.col("config")) | (repeat.cast("int") != F.col("repeat")),
        "config or repeat differ from the file name",
    )
    return lines.withColumn("problem", problem).where("problem IS NOT NULL")


def answered_twice(lines: DataFrame) -> DataFrame:
    """Questions answered more than once in one file."""
    return lines.groupBy("file_name", "item_id").agg(F.count("*").alias("n")).where("n > 1")


def unknown_items(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Lines whose question is not in the set."""
    return lines.join(items.select("item_id"), "item_id", "left_anti")


def rescored(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Lines whose stored correctness differs from a fresh score."""
    stored = lines.withColumnRenamed("correct", "stored")
    return score_answers(stored, items).where(~F.col("stored").eqNullSafe(F.col("correct")))


def missing_answers(lines: DataFrame, items: DataFrame, plan: DataFrame) -> DataFrame:
    """plan(config, category, repeats) -> per configuration and repeat: planned, not answered."""
    wanted = plan.withColumn(
        "repeat", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))
    ).join(items.select("item_id", "category"), "category").select(*KEY)
    answered = lines.select(*KEY).distinct().withColumn("done", F.lit(1))
    return wanted.join(answered, KEY, "left").groupBy("config", "repeat").agg(
        F.count("*").alias("planned"), F.count_if(F.col("done").isNull()).alias("missing")
    )


def over_quota(quota: DataFrame, limit: int) -> DataFrame:
    """Days with more requests than the observed daily limit."""
    return quota.where(F.col("requests") > limit)


def calls_against_requests(lines: DataFrame, quota: DataFrame) -> DataFrame:
    """Days whose lines hold more model calls than the provider's requests explain."""
    calls = lines.groupBy(F.col("date").alias("day")).agg(F.sum(llm_calls()).alias("calls"))
    met = calls.join(quota.select("day", "requests"), "day", "left")
    requests = F.coalesce("requests", F.lit(0))
    return met.select("day", "calls", requests.alias("requests")).where(
        F.col("calls") > F.col("requests") * REPLAY_ALLOWANCE + REPLAY_SLACK
    )


def cache_isolation(lines: DataFrame, baseline: str = "A0") -> DataFrame:
    """Configurations that spent under half of the full system's requests per answer."""
    rates = lines.groupBy("config").agg(F.avg(requests_spent()).alias("per_answer"))
    full = rates.where(F.col("config") == baseline).select("per_answer").scalar()
    return rates.where(F.col("config") != baseline).select(
        "config", "per_answer", full.alias("baseline"),
        (F.col("per_answer") < full * RATE_FLOOR).alias("suspicious"),
    )


def _tool_calls(side: str) -> Column:
    return F.transform(
        F.filter(f"{side}.steps", lambda s: s["kind"] == "tool"),
        lambda s: F.struct(s["name"].alias("name"), s["arguments"].alias("arguments")),
    )


def replay_diff(originals: DataFrame, replays: DataFrame) -> DataFrame:
    """Per original line: status (identical, differs, missed) and the names of differing fields."""
    a, b = originals.alias("a"), replays.alias("b")
    same_key = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in KEY]
    joined = a.join(b, same_key[0] & same_key[1] & same_key[2], "left")
    compared = {
        name: (F.col(f"a.{name}"), F.col(f"b.{name}"))
        for name in ("answer", "answer_ids", "evidence_ids", "abstained", "stopped_reason")
    }
    compared["tool calls"] = (_tool_calls("a"), _tool_calls("b"))
    compared["tool call count"] = (F.col("a.tool_calls"), F.col("b.tool_calls"))
    compared["input_tokens"] = (F.col("a.input_tokens"), F.col("b.input_tokens"))
    compared["output_tokens"] = (F.col("a.output_tokens"), F.col("b.output_tokens"))
    changed = F.array_compact(
        F.array(*[F.when(~x.eqNullSafe(y), F.lit(n)) for n, (x, y) in compared.items()])
    )
    missed = F.col("b.item_id").isNull()
    status = F.when(missed, "missed").when(F.size(changed) > 0, "differs").otherwise("identical")
    nothing = F.array().cast("array<string>")
    return joined.select(
        F.col("a.file_name").alias("file_name"), *[F.col(f"a.{k}").alias(k) for k in KEY],
        status.alias("status"), F.when(missed, nothing).otherwise(changed).alias("differs"),
    )


def replay_rewrite(lines: DataFrame, replays: DataFrame, old: str, frozen: str) -> DataFrame:
    """Lines to keep: those not of the old tree, and old ones whose replay is identical, re-stamped."""
    untouched = lines.where(F.col("frozen_tree_hash") != old).withColumns(
        {"produced_by": F.lit(None).cast("string"), "equivalence": F.lit(None).cast("string")}
    )
    originals = lines.where(F.col("frozen_tree_hash") == old)
    same = replay_diff(originals, replays).where("status = 'identical'").select(*KEY)
    proved = originals.join(same, KEY, "left_semi").withColumns(
        {"frozen_tree_hash": F.lit(frozen), "produced_by": F.lit(old),
         "equivalence": F.lit("cache_replay_verified")}
    )
    return untouched.unionByName(proved)


def replay_totals(diff: DataFrame) -> DataFrame:
    """Checked, identical, differing and missed lines per file and in total."""
    return diff.rollup("file_name").agg(
        F.count("*").alias("checked"), F.count_if(F.col("status") == "identical").alias("identical"),
        F.count_if(F.col("status") == "differs").alias("differs"),
        F.count_if(F.col("status") == "missed").alias("missed"),
    ).withColumn("file_name", F.coalesce("file_name", F.lit("total")))


def published_differences(published: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows only published and rows only recomputed."""
    return published.exceptAll(recomputed).withColumn("side", F.lit("published")).union(
        recomputed.exceptAll(published).withColumn("side", F.lit("recomputed"))
    )


def text_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line of every text, numbered from 1."""
    return texts.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line_text")).select(
        key, (F.col("pos") + 1).alias("line"), "line_text"
    )


def secret_scan(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, kind) of every credential found, never the credential itself."""
    found = text_lines(texts, key, text).select(
        key, "line", F.explode(secret_kinds(F.col("line_text"))).alias("kind")
    )
    return found


def term_hits(terms: list[str]) -> Callable[[Column], Column]:
    """A column function: the (line, term number) pairs of a lower-cased text, each once, in order.

    All terms are sought in one pass over the text by an automaton that every task makes once, so
    neither the plan nor the time for a text grows with the number of terms. Lines and terms are
    numbered from 1; a term with a line break is in no line, an empty one is in every line. A null
    text has no hits. The list of terms goes to every task: it is given by the caller, not by data.
    """
    lowered = [t.lower() for t in terms]

    @F.pandas_udf("array<struct<line:int,term_number:int>>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        numbers: dict[str, list[int]] = {}
        for number, term in enumerate(lowered, 1):
            numbers.setdefault(term, []).append(number)
        everywhere = numbers.pop("", [])
        automaton = ahocorasick.Automaton()
        for term, held in numbers.items():
            automaton.add_word(term, held)
        automaton.make_automaton()

        def found(text: str | None) -> list[tuple[int, int]] | None:
            if text is None:
                return None
            out = []
            for line, content in enumerate(text.split("\n"), 1):
                met = set(everywhere)
                if numbers:
                    for _, held in automaton.iter(content):
                        met.update(held)
                out.extend((line, number) for number in sorted(met))
            return out

        for texts in batches:
            yield texts.map(found)

    return hits


def term_scan(texts: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(key, line, term number) of forbidden terms, ignoring case; the term is not repeated."""
    return texts.select(key, F.inline(term_hits(terms)(F.lower(text))))


def version_scan(versions: DataFrame, terms: list[str]) -> DataFrame:
    """versions(path, version, text): every distinct text is scanned once; its first holder is
    reported with the term numbers and credential kinds it holds."""
    hashed = versions.withColumn("blob", F.sha2("text", 256))
    first = hashed.groupBy("blob").agg(
        F.min_by("path", "version").alias("path"), F.min("version").alias("version"),
        F.count("*").alias("holders"), F.min_by("text", "version").alias("text"),
    ).withColumn("_terms", term_hits(terms)(F.lower("text")))
    held = F.transform(
        F.array_distinct("_terms.term_number"), lambda n: F.concat(F.lit("term "), n.cast("string"))
    )
    hits = F.concat(held, secret_kinds(F.col("text")))
    return first.select("path", "version", "holders", F.explode(hits).alias("hit"))


def missing_local_links(pages: DataFrame, key: str, body: str, known: DataFrame) -> DataFrame:
    """Local link targets (without their anchor) of each page that are not in known(target)."""
    targets = pages.select(key, F.explode(markdown_links(F.col(body))).alias("link")).where(
        link_kind(F.col("link")) == "local"
    )
    bare = targets.select(key, F.split("link", "#")[0].alias("target")).distinct()
    return bare.join(known.select("target").distinct(), "target", "left_anti").select(key, "target")
