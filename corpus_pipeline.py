"""The training-data pipeline: documents through five stages, each written before the next reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.decontamination import decontaminate
from quarrylight.llm.near_duplicates import Link, near_duplicates
from quarrylight.llm.quality_rules import quality_rules
from quarrylight.llm.queries import token_dataset
from quarrylight.llm.source_mixing import mix_sources
from quarrylight.llm.tables import table
from quarrylight.sources.staging import staging_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines; n_chars follows the text."""
    kept = quality_rules(docs).where("kept")
    columns = [F.col("cleaned").alias(c) if c == "text" else F.length("cleaned").cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns]
    return kept.select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id (nulls last).

    Rows are told apart by id and text, so of two texts that share an id only a duplicate goes. Of equal rows
    one stays.
    """
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    found = near_duplicates(keyed.select("__key", "text"), Link(words=5, percent=80), id_column="__key")
    members = found.select("__key", "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__key")
    first = keyed.select("__key", "doc_id").distinct().join(members, "__key").groupBy("component_id").agg(F.min(order).alias("first"))
    kept = keyed.join(first.select(F.col("first")["__key"].alias("__key")), "__key", "left_semi")
    repeated = keyed.groupBy("__key").agg(F.count("*").alias("n")).where("n > 1").select("__key")
    single = kept.join(repeated, "__key", "left_anti")
    several = kept.join(repeated, "__key", "left_semi").dropDuplicates(["__key"])
    return single.unionByName(several).select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule does not catch."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks; every document once at least."""
    return mix_sources(docs).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, written in ascending id order and read back."""
    return token_dataset(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", benchmark_free),
    ("source_mix", mixed_sources),
    ("token_ids", token_ids),
]

# The last stage's ids come from a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{staging_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        done = stage(spark, docs, sf_dir)
        done.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(done.schema).parquet(f"{folder}/{name}")
    return docs
