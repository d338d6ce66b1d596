"""Helpers shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.plans.checkpoints import settle, shared_dir

__all__ = ["crc32_mod", "map_arrow", "one_thread", "settle", "small_batches", "shared_dir", "slices", "table", "utf8", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(id_column: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % n


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Sets the session's Arrow batches to about ``size`` from here on. A batch is held on both sides several times over,
    and with long texts the default of 64 MB fills what an executor has beside its heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, size: str = "4m") -> DataFrame:
    """``df.mapInArrow`` with small batches."""
    small_batches(df.sparkSession, size)
    return df.mapInArrow(f, schema)


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once and written as a table of the shared folder, of which readers take the columns they need."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_thread(spark: SparkSession) -> None:
    """Lets the Python workers started from here on multiply matrices in one thread: an executor has a task for each core."""
    spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string or binary Arrow column as bytes objects, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that ``column`` holds about ``max_bytes`` in each: long texts bound the memory, not rows."""
    for batch in batches:
        size = batch.column(column).nbytes
        if size <= max_bytes or batch.num_rows < 2:
            yield batch
            continue
        step = max(1, int(batch.num_rows * max_bytes / size))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
