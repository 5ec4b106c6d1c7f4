"""Streams: re-extraction of files as they arrive, and call statistics of the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.extract import base_relations
from ..sources.registry import Snapshots
from ..sources.scan import files_relation

AUDIT = "event string, ts timestamp, tool string, paths array<string>, bytes long, durationMs long, isError boolean, session string"


def watch_files(spark: SparkSession, root: str, snapshots: Snapshots, project: str, checkpoint: str):
    """A streaming query that re-extracts new and changed files of ``root`` and replaces their rows in the snapshot."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root)
    rows = raw.select(F.regexp_replace(F.regexp_replace("path", r"^file:/*(?=/)", ""), r"^file:", "").alias("path"), "content", "length", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))

    def replace(batch: DataFrame, _: int) -> None:
        files, _errors = files_relation(batch, root, project, max_files=None)
        old, new = snapshots.load(project), base_relations(files, cache=False)
        if old is None:
            snapshots.save(project, new)
        else:
            paths = files.select("path").distinct()
            snapshots.save(project, {k: old[k].join(paths, "path", "left_anti").unionByName(new[k]) for k in old})

    return rows.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint)


def call_statistics(spark: SparkSession, folder: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Calls, errors and mean duration per tool and window of the audit log; rows later than ``late`` are left out."""
    rows = spark.readStream.schema(AUDIT).json(folder).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window), "tool").agg(F.count("*").alias("calls"), F.sum(F.col("isError").cast("long")).alias("errors"), F.avg("durationMs").alias("mean_ms"))
