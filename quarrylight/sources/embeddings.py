"""Vectors for texts: hashed words by default, a caller's encoder on request, and a store of both.

The store at a path grows by the texts it does not hold, found by a key of model, dimension and text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.scalars import content_key
from quarrylight.functions.vectors import EMBEDDING_DIM, hash_embed, l2_normalize
from quarrylight.sources.staging import stored

TEXTS_PER_CALL = 64
Encoder = Callable[[list[str]], np.ndarray]


def blank_separated(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda word: word != "")


def embed_texts(
    texts: DataFrame, key: str, text: str, make_encoder: Callable[[int], Encoder] | None = None, dim: int = EMBEDDING_DIM
) -> DataFrame:
    """key -> embedding of length one (or zero).

    Without an encoder the words of a text are hashed into `dim` buckets, all in Spark's own functions.
    `make_encoder(dim)` is called once per task and its result with 64 texts at a time; vectors of
    another dimension fail the job.
    """
    if make_encoder is None:
        return hash_embed(texts, key, text, dim, blank_separated)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder(dim)
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS_PER_CALL):
                few = batch.slice(first, TEXTS_PER_CALL)
                vectors = np.asarray(encoder(few.column(1).to_pylist()), dtype=np.float64)
                if vectors.shape != (few.num_rows, dim):
                    raise ValueError(f"encoder returned {vectors.shape}, expected ({few.num_rows}, {dim})")
                rows = pa.array(list(vectors), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([few.column(0), rows], [key, "raw"])

    kind = texts.schema[key].dataType.simpleString()
    raw = texts.select(key, text).mapInArrow(encoded, f"{key} {kind}, raw array<double>")
    return raw.select(key, l2_normalize(F.col("raw")).alias("embedding"))


def keyed_texts(texts: DataFrame, text: str, model: str, dim: int) -> DataFrame:
    """Distinct texts with their content key."""
    key = content_key(F.lit(model), F.lit(str(dim)), F.col(text))
    return texts.select(key.alias("text_key"), F.col(text).alias("text")).dropDuplicates(["text_key"])


def extend_store(
    path: str, texts: DataFrame, text: str, model: str, make_encoder: Callable[[int], Encoder] | None = None,
    dim: int = EMBEDDING_DIM,
) -> DataFrame:
    """Append the vectors of texts the store at `path` does not hold, and return the store."""
    wanted = keyed_texts(texts, text, model, dim)
    held = stored(texts.sparkSession, path)
    if held is not None:
        wanted = wanted.join(held.select("text_key"), "text_key", "left_anti")
    fresh = embed_texts(wanted, "text_key", "text", make_encoder, dim)
    fresh.withColumn("model", F.lit(model)).write.mode("append").parquet(path)
    return texts.sparkSession.read.parquet(path)
