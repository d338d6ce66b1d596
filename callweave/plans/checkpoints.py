"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new one where a local session names none
    (tests)."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            found = tempfile.mkdtemp(prefix="callweave-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; its plan starts there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system, if it's there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(*settled: DataFrame) -> None:
    """Deletes the files of settled DataFrames that nothing reads any more, as the rounds of a loop leave them behind."""
    for df in settled:
        place = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if place.isDefined():
            remove(df.sparkSession, place.get())


def broadcast_if_small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is; at most ``rows`` + 1 are counted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
