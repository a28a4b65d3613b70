"""Tables written to the shared folder, so that a plan ends there and a lost executor costs its tasks only."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that executors share, as ``spark.checkpoint.dir`` names it; in local mode without one, a folder of the session's warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


#: Spark's setting that removes a query's shuffle files as soon as it has ended.
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, sweep: bool = False) -> DataFrame:
    """Writes a table to the shared folder and reads it back, so that an iteration's plan doesn't grow.

    ``sweep``: Spark removes the shuffle files that the write needed when it has ended, not when it collects garbage."""
    path = scratch(df.sparkSession, "cut")
    conf = df.sparkSession.conf
    before = conf.get(_SWEEP, None)
    if sweep:
        conf.set(_SWEEP, "true")
    try:
        df.write.parquet(path)
    finally:
        if sweep:
            conf.unset(_SWEEP) if before is None else conf.set(_SWEEP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables of ``cut`` that no later plan reads."""
    for df in tables:
        if path := getattr(df, "_cut_at", None):
            p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shipped(df: DataFrame) -> DataFrame:
    """``df``, after the Python workers of its session were told where this package is, wherever the driver started."""
    root = str(Path(__file__).resolve().parents[2])
    env = df.sparkSession.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)
    return df
