"""Projects: indexing, status, deletion, and named operations over them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.registry import MODES, Registry, Snapshots, newest, parse_ref
from ..sources.scan import scan


class Workspace:
    """A registry and the snapshots of its projects; loaded projects stay at hand."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.registry, self.snapshots = Registry(spark, f"{root}/projects"), Snapshots(spark, f"{root}/snapshots")
        self.loaded: dict[str, dict[str, DataFrame]] = {}

    def index(self, ref: str, mode: str = "full", force: bool = False) -> dict:
        """Index a project; nothing is done if it was indexed in this mode and no file is newer. All modes index in full."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        path = parse_ref(ref)
        files, errors = scan(self.spark, path)
        known = self.registry.get(path)
        if known and not force and known["mode"] == mode and self.status(ref, files)["fresh"] and self.snapshots.load(path) is not None:
            return known | {"status": "unchanged", "errors": errors.count()}
        base = self.snapshots.refresh(path, files)
        self.loaded[path] = base
        languages = [r["lang"] for r in base["files"].select("lang").distinct().orderBy("lang").collect()]
        row = {"name": path.rpartition("/")[2], "path": path, "indexed_at": datetime.now(timezone.utc).replace(tzinfo=None), "files": base["files"].count(), "languages": languages, "mode": mode}
        self.registry.upsert(row)
        return row | {"status": "indexed", "errors": errors.count()}

    def project(self, ref: str) -> dict[str, DataFrame]:
        path = parse_ref(ref)
        if path not in self.loaded:
            base = self.snapshots.load(path)
            if base is None:
                self.index(ref)
                base = self.snapshots.load(path)
            self.loaded[path] = base
        return self.loaded[path]

    def status(self, ref: str, files: DataFrame | None = None) -> dict:
        """Whether a project is indexed, and whether no file is newer than that."""
        path = parse_ref(ref)
        known = self.registry.get(path)
        if known is None:
            return {"path": path, "indexed": False, "fresh": False}
        row = newest(files if files is not None else scan(self.spark, path)[0]).first()
        at = known["indexed_at"].replace(tzinfo=timezone.utc).timestamp() * 1e9
        return {"path": path, "indexed": True, "indexed_at": known["indexed_at"], "files": known["files"], "newest": row["newest"], "fresh": row["newest"] is None or row["newest"] <= at}

    def projects(self) -> DataFrame:
        return self.registry.list()

    def delete(self, ref: str) -> dict:
        """Forget a project; doing it again changes nothing."""
        path = parse_ref(ref)
        had = self.registry.get(path) is not None
        self.registry.delete(path)
        self.snapshots.delete(path)
        self.loaded.pop(path, None)
        return {"path": path, "deleted": had}


class NamedOperations:
    """Operations by id: a tool with fixed arguments, to which a call adds its own (``op`` itself is not passed on)."""

    def __init__(self, tools: dict[str, Callable[..., object]]):
        self.tools, self.ops = tools, {}

    def add(self, op: str, tool: str, description: str = "", **fixed) -> None:
        if tool not in self.tools:
            raise ValueError(f"no tool {tool!r}")
        self.ops[op] = (description, tool, fixed)

    def list(self) -> list[tuple[str, str, str]]:
        return sorted((op, tool, text) for op, (text, tool, _) in self.ops.items())

    def run(self, op: str, /, **args) -> object:
        if op not in self.ops:
            raise LookupError(f"no operation {op!r}")
        _, tool, fixed = self.ops[op]
        args.pop("op", None)
        return self.tools[tool](**(fixed | args))


def default_operations(base: dict[str, DataFrame], root: str) -> NamedOperations:
    """Four operations on a project's relations."""
    from ..operators import architecture, edges, names, tree

    tools = {
        "overview": lambda depth=2, scope=None: tree.overview(base, root, depth, scope),
        "search": lambda query, limit=10, kinds=None: names.search(base["symbols"], query, kinds, limit=limit),
        "edges": lambda node, kinds=edges.DEFAULT_KINDS, limit=50: edges.node_edges(base, node, tuple(kinds), limit)[0],
        "hotspots": lambda top=10: architecture.hotspots(base["symbols"].dropDuplicates(["id"]), base["call_edges"].select(F.col("caller_id").alias("src"), F.col("callee_name").alias("dst")), top),
    }
    ops = NamedOperations(tools)
    ops.add("overview-shallow", "overview", "packages and files", depth=1)
    ops.add("find-functions", "search", "functions by words", kinds=["function"])
    ops.add("who-calls", "edges", "callers of a node", kinds=["CALLERS"])
    ops.add("busiest", "hotspots", "the ten busiest symbols", top=10)
    return ops
