"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop, new_path, stored, stored_alone
from ..shipping import ship_package

__all__ = ["crc_of_id", "drop", "join_counted", "new_path", "quoted", "release_memory", "releasing", "small_batches", "stored", "stored_alone", "table"]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Prepare for Python operators: ship the package; bound Arrow batches to ``rows`` rows, and 16 MB where Spark can.

    Results are lazy, so the settings stay with the session; they are only ever lowered.
    """
    ship_package(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def release_memory() -> None:
    """Give freed memory back to the system, so that a long-lived process does not keep its peak."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # other C libraries have no such call
        pass


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, after which the worker gives back what it freed: Spark keeps it for later tasks."""

    def held(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return held


HOT_ROWS = 100_000


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined by ``key`` with ``keyed``: a stored table with one row per key, and in ``count`` how many of the ``total`` rows have it.

    Keys of ``HOT_ROWS`` rows and a ten-thousandth of all are no more than 10,000: these are broadcast, so that the rows
    of a hot key stay where they are. All others meet by shuffle.
    """
    if total < HOT_ROWS:
        return rows.join(keyed, key)
    least = max(HOT_ROWS, -(-total // 10_000))
    hot = keyed.where(F.col(count) >= least)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.where(F.col(count) < least), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def quoted(name: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def crc_of_id(doc_id: Column | str) -> Column:
    """crc32 of the id written as decimal text (null for a null id)."""
    return F.crc32(F.encode(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), "utf-8"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
