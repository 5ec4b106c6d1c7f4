"""Tables in the shared folder that cut lineage between steps, and their removal."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Only a local master, whose executors share this machine's disk, may do without
    one; it gets a folder of its own. Raises RuntimeError on a cluster that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sievework-shared-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that ``forget_stored`` will remove."""
    path = f"{shared_dir(spark)}/sievework-{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, which lost executors cannot take along."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def stored_alone(tag: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``stored`` for what ``make`` returns; all other tables that were stored meanwhile are removed."""
    before = set(_written)
    out = stored(make(), tag)
    _remove(out.sparkSession, [p for p in _written if p not in before and p != out._stored_at])
    return out


def drop(df: DataFrame) -> None:
    """Remove a table that ``stored`` returned and that nothing reads any more."""
    _remove(df.sparkSession, [df._stored_at])


def forget_stored(spark: SparkSession) -> None:
    """Remove all that this session's operators have stored (their results must be saved by then)."""
    _remove(spark, _written[:])


def _remove(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        if path in _written:
            _written.remove(path)
