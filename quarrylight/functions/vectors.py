"""Vector expressions over ARRAY<DOUBLE> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.text import tokenize

EMBEDDING_DIM = 64


def dot_product(left: Column, right: Column) -> Column:
    """Sum of products, accumulated in double, in array order."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def l2_normalize(vector: Column) -> Column:
    """The vector over its length; a zero vector stays zero."""
    return _divide(vector, F.sqrt(dot_product(vector, vector)))


def _divide(vector: Column, norm: Column) -> Column:
    # The one-element array binds the norm once per row instead of once per component.
    return F.transform(
        F.array(norm),
        lambda n: F.transform(
            vector, lambda v: F.when(n > 0, v.cast("double") / n).otherwise(F.lit(0.0))
        ),
    )[0]


def hash_bucket(token: Column, dim: int = EMBEDDING_DIM) -> Column:
    """Bucket of a token: 32 bits of its md5 modulo the dimension."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def hash_sign(token: Column) -> Column:
    """+1 or -1 by the next bit of the md5."""
    bit = F.conv(F.substring(F.md5(token), 9, 2), 16, 10).cast("int") % 2
    return F.when(bit == 1, 1).otherwise(-1)


def hash_embed(
    texts: DataFrame, key: str, text: str, dim: int = EMBEDDING_DIM, cut: Callable[[Column], Column] = tokenize
) -> DataFrame:
    """key -> embedding: signed token counts hashed into `dim` buckets, length one.

    `cut` gives a text's tokens as an array.
    The texts are dealt out by key, the only shuffle; rows of one key are summed together. Texts
    without tokens get the zero vector.
    """
    tokens = texts.select(key, text).repartition(key).select(key, F.explode_outer(cut(F.col(text))).alias("token"))
    sums = tokens.groupBy(key, hash_bucket(F.col("token"), dim).alias("bucket")).agg(
        F.sum(hash_sign(F.col("token"))).alias("value")
    )
    entry = F.when(F.col("bucket").isNotNull(), F.struct("bucket", "value"))
    filled = sums.groupBy(key).agg(
        F.map_from_entries(F.collect_list(entry)).alias("values"),
        F.sqrt(F.sum(F.col("value").cast("double") * F.col("value"))).alias("norm"),
    )
    places = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.coalesce(F.try_element_at("values", i), F.lit(0))
        / F.when(F.col("norm") > 0, F.col("norm")).otherwise(F.lit(1.0)),
    )
    return filled.select(key, places.alias("embedding"))
