"""Reading the input tables, and small helpers that several operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters that the tokenizers' regular expressions call white space (Unicode White_Space).
# Fixed values.
WHITE = "\t-\r \x85\xa0  -     　"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def bits_for(n: int) -> int:
    """Bits that tell n things apart, 1 at least."""
    return max(1, math.ceil(math.log2(max(2, n))))


def hex_digest(values: Column) -> Column:
    """Lowercase sha-256 of a string column's UTF-8 bytes."""
    return F.sha2(F.encode(values, "UTF-8"), 256)


def computed(df: DataFrame, *columns: Column) -> DataFrame:
    """df's column `row` and the given columns, each worked out once.

    The columns pass through a generator of one row, which filters above are not pushed through; pushed
    down, a filter would repeat the expressions it names, once for every time they use one another.
    """
    return df.select("row", F.inline(F.array(F.struct(*columns))))
