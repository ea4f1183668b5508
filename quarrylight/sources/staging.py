"""Cutting lineage: intermediate tables written to the shared checkpoint folder.

Iterative operators write each level once and read it back. The files survive the loss of an
executor, carry sizes Catalyst can plan with, and keep the plan of level n independent of the
plans of levels 1..n-1.
"""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables that `stage` returned.
PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def staging_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarrylight-"))
    return spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once and return a scan of the written table."""
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    PATHS[staged] = path
    return staged


def release(*staged: DataFrame) -> None:
    """Free the disk of tables that `stage` returned: an empty table is written over each.

    Only for tables from which all that is still needed has been written elsewhere.
    """
    for df in staged:
        df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(PATHS.pop(df))


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at a path; None where there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
