"""Stores of the engine: the project registry, snapshots of base relations, and the audit log."""

from __future__ import annotations

import json
import re
import time
import urllib.parse
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROJECT = "name string, path string, indexed_at timestamp, files int, languages array<string>, mode string"
MODES = ("full", "fast", "symbols", "lazy")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def new_version() -> str:
    return f"v-{time.time_ns():020d}"


def versions(spark: SparkSession, home: str) -> list[str]:
    """The complete versions in a folder, oldest first. A version counts once its mark is there, which is written last."""
    fs, p = _fs(spark, home)
    names = sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
    return [n for n in names if n.startswith("v-") and exists(spark, f"{home}/{n}/_COMPLETE")]


def publish(spark: SparkSession, home: str, version: str) -> None:
    """Mark a finished version. The one before stays for readers that have begun; older ones go, and so do unmarked ones that a lost writer left."""
    fs, mark = _fs(spark, f"{home}/{version}/_COMPLETE")
    fs.create(mark).close()
    keep = versions(spark, home)[-2:]
    for x in fs.listStatus(_fs(spark, home)[1]):
        name = x.getPath().getName()
        if name.startswith("v-") and name not in keep and name < keep[-1]:
            delete(spark, f"{home}/{name}")


class Registry:
    """Projects, one row per path, as versions of a JSON table: a reader sees the newest complete one, and there is always one. An unreadable
    version is set aside, and the one before counts. Of two writers at a time the later one wins."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self) -> DataFrame:
        for name in reversed(versions(self.spark, self.path)):
            try:
                rows = self.spark.read.schema(PROJECT).option("mode", "FAILFAST").json(f"{self.path}/{name}").collect()  # one row per project
                return self.spark.createDataFrame(rows, PROJECT)
            except Exception:
                fs, p = _fs(self.spark, f"{self.path}/{name}")
                fs.rename(p, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/corrupt-{name}"))
        return self.spark.createDataFrame([], PROJECT)

    def list(self) -> DataFrame:
        return self._read().orderBy("path")

    def get(self, path: str) -> dict | None:
        row = self._read().where(F.col("path") == path).first()
        return row.asDict() if row else None

    def _write(self, df: DataFrame) -> None:
        new = new_version()
        df.coalesce(1).write.json(f"{self.path}/{new}")
        publish(self.spark, self.path, new)

    def upsert(self, project: dict) -> None:
        one = self.spark.createDataFrame([project], PROJECT)
        self._write(self._read().join(one.select("path"), "path", "left_anti").select(one.columns).unionAll(one).orderBy("path"))

    def delete(self, path: str) -> None:
        """Remove a project; nothing happens if there is none."""
        self._write(self._read().where(F.col("path") != path))


TABLES = ("files", "symbols", "call_edges", "call_sites", "imports", "inherits")


class Snapshots:
    """Base relations of projects as Parquet tables, valid for files of unchanged path and time.

    Each snapshot is a folder of its own, and counts once its mark is there, which is written last: readers see all tables of one
    snapshot or all of the one before, also if the writer is lost. The one before stays for readers that have begun.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _home(self, project: str) -> str:
        import hashlib

        return f"{self.root}/{hashlib.sha256(project.encode()).hexdigest()}"

    def _versions(self, home: str) -> list[str]:
        """Complete snapshots, oldest first."""
        return versions(self.spark, home)

    def save(self, project: str, base: dict[str, DataFrame]) -> None:
        """Write a new snapshot, which may read the last one, then remove those before that."""
        home, new = self._home(project), new_version()
        for name in TABLES:
            base[name].write.parquet(f"{home}/{new}/{name}")
        publish(self.spark, home, new)

    def load(self, project: str) -> dict[str, DataFrame] | None:
        from ..operators.pattern import lines_of

        home = self._home(project)
        known = self._versions(home)
        if not known:
            return None
        base = {n: self.spark.read.parquet(f"{home}/{known[-1]}/{n}") for n in TABLES}
        return base | {"lines": lines_of(base["files"], ["path"], "text")}

    def delete(self, project: str) -> bool:
        return delete(self.spark, self._home(project))

    def evict(self, most_bytes: int) -> list[str]:
        """Remove whole projects, those saved longest ago first, until the rest has at most ``most_bytes``; returns their folders."""
        fs, root = _fs(self.spark, self.root)
        if not fs.exists(root):
            return []
        homes = [x.getPath().getName() for x in fs.listStatus(root)]
        kept = sorted((max(self._versions(f"{self.root}/{h}"), default=""), h) for h in homes)
        size = {h: fs.getContentSummary(_fs(self.spark, f"{self.root}/{h}")[1]).getLength() for h in homes}
        total, gone = sum(size.values()), []
        for _, h in kept:
            if total <= most_bytes:
                break
            delete(self.spark, f"{self.root}/{h}")
            total -= size[h]
            gone.append(h)
        return gone

    def stale(self, project: str, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(changed or new files, paths that are gone) of a fresh scan against the snapshot."""
        old = self.load(project)
        if old is None:
            return files, files.select("path").limit(0)
        seen = old["files"].select("path", "mtime_ns")
        return files.join(seen, ["path", "mtime_ns"], "left_anti"), seen.select("path").join(files.select("path"), "path", "left_anti")

    def refresh(self, project: str, files: DataFrame) -> dict[str, DataFrame]:
        """Extract only what changed, drop what is gone, keep the rest, and save."""
        from .extract import base_relations

        old = self.load(project)
        if old is None:
            base = base_relations(files)
        else:
            changed, gone = self.stale(project, files)
            drop = gone.unionAll(changed.select("path")).distinct()
            new = base_relations(changed)
            base = {k: old[k].join(drop, "path", "left_anti").unionByName(new[k]) for k in old}
        self.save(project, base)
        return self.load(project)


PATH_FIELDS = re.compile(r"(?:^|_)(?:path|file|root|uri|scope|project|dir)s?$", re.I)


def extract_paths(value, field: str = "") -> list[str]:
    """Paths in a call's arguments: texts of fields with such a name, and texts that look like absolute paths."""
    out: list[str] = []
    if isinstance(value, dict):
        for k, v in value.items():
            out += extract_paths(v, k)
    elif isinstance(value, (list, tuple)):
        for v in value:
            out += extract_paths(v, field)
    elif isinstance(value, str) and value and (PATH_FIELDS.search(re.sub(r"(?<=[a-z])(?=[A-Z])", "_", field)) or re.match(r"/[^\s]+|file://", value)):
        out.append(value)
    return list(dict.fromkeys(out))


class Audit:
    """Appends one JSON line per call."""

    def __init__(self, path: str):
        self.path = path

    def log(self, tool: str, args: dict, size: int, ms: int, is_error: bool, session: str = "") -> None:
        row = {"event": "tool_call", "ts": datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), "tool": tool, "paths": extract_paths(args), "bytes": size, "durationMs": ms, "isError": is_error, "session": session}
        with open(self.path, "a") as f:
            f.write(json.dumps(row, ensure_ascii=False) + "\n")

    def watch(self, tool: str, function, session: str = ""):
        """The function with its calls logged."""

        def call(**args):
            start, error, out = time.time(), True, None
            try:
                out = function(**args)
                error = False
                return out
            finally:
                self.log(tool, args, len(repr(out)) if out is not None else 0, int((time.time() - start) * 1000), error, session)

        return call


def parse_ref(ref: str) -> str:
    """The absolute path of a project reference: a plain absolute path or a file: URL, without any way upwards."""
    path = ref
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", ref):
        url = urllib.parse.urlparse(ref)
        if url.scheme != "file" or url.netloc not in ("", "localhost"):
            raise ValueError(f"not a local project: {ref!r}")
        path = url.path
    seen = path
    for _ in range(3):
        if ".." in seen.split("/") or "\0" in seen:
            raise ValueError(f"a project path must not lead upwards: {ref!r}")
        seen = urllib.parse.unquote(seen)
    path = urllib.parse.unquote(path)
    if not path.startswith("/"):
        raise ValueError(f"a project path is absolute: {ref!r}")
    return re.sub(r"/+", "/", path).rstrip("/") or "/"


def newest(files: DataFrame, time_col: str = "mtime_ns") -> DataFrame:
    return files.agg(F.max(time_col).alias("newest"), F.count("*").alias("files"))


def freshness(rows: DataFrame, time_col: str, since) -> DataFrame:
    """(newest, rows, fresh): fresh if nothing is newer than ``since``."""
    return rows.agg(F.max(time_col).alias("newest"), F.count("*").alias("rows")).withColumn("fresh", F.coalesce(F.col("newest") <= F.lit(since), F.lit(True)))
