"""Structural reports: counts, packages, hotspots, dead code, import resolution and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..semantics import DEFAULT, Semantics
from ..session import stored
from .traverse import strong_components

TOP_PACKAGES, TOP, MAX_TOP, MAX_DEAD, MAX_CYCLES, MAX_CYCLE_FILES = 10, 10, 100, 50, 10, 20


def counts(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(what, n): files, distinct non-empty packages, and symbols of each kind."""
    a = files.agg(F.count("*").alias("files"), F.count_distinct(F.when(F.col("pkg") != "", F.col("pkg"))).alias("packages")).select(F.explode(F.create_map(F.lit("files"), F.col("files"), F.lit("packages"), F.col("packages"))).alias("what", "n"))
    return a.unionAll(symbols.groupBy(F.col("kind").alias("what")).agg(F.count("*").alias("n")))


def by_count(df: DataFrame, col: str, limit: int | None = None) -> DataFrame:
    """(col, n), most frequent first, ties by name; empty names are left out."""
    out = df.where(F.col(col).isNotNull() & (F.col(col) != "")).groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col)
    return out.limit(limit) if limit else out


def degree(edges: DataFrame, semantics: Semantics = DEFAULT) -> DataFrame:
    """(id, degree) from distinct (src, dst): how many it points at ("out"), or how many point at it ("in")."""
    a, b = ("src", "dst") if semantics.degree == "out" else ("dst", "src")
    return edges.groupBy(F.col(a).alias("id")).agg(F.count_distinct(b).alias("degree"))


def hotspots(nodes: DataFrame, edges: DataFrame, top: int = TOP, semantics: Semantics = DEFAULT) -> DataFrame:
    """The nodes (id, ...) of the largest degree above 0, ties by id."""
    return nodes.join(degree(edges, semantics), "id").where("degree > 0").orderBy(F.desc("degree"), "id").limit(min(top, MAX_TOP))


def dead(nodes: DataFrame, edges: DataFrame, limit: int | None = MAX_DEAD, semantics: Semantics = DEFAULT) -> DataFrame:
    """Nodes of degree 0, in order of id."""
    end = "src" if semantics.degree == "out" else "dst"
    out = nodes.join(edges.select(F.col(end).alias("id")).distinct(), "id", "left_anti").orderBy("id")
    return out.limit(limit) if limit else out


def dead_symbols(symbols: DataFrame, calls: DataFrame, limit: int | None = MAX_DEAD, semantics: Semantics = DEFAULT) -> DataFrame:
    """Dead code among symbols: exported names of Go are left out."""
    named = calls.select(F.col("caller_id").alias("src"), F.col("callee_name").alias("dst")) if semantics.degree == "out" else calls.join(symbols.select(F.col("id").alias("dst"), "name"), F.col("callee_name") == F.col("name")).select(F.col("caller_id").alias("src"), "dst")
    own = symbols.where(~((F.col("lang") == "go") & F.col("name").rlike("^[A-Z]"))).dropDuplicates(["id"])
    return dead(own, named, limit, semantics)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): each importing file with the first file of the package that it imports.

    A package is found by its whole name, else as the end of one after ``/`` or ``.`` (the smallest name), else relative
    to the importer's directory.
    """
    homes = stored(files.select("path", "pkg"), "packages")  # narrow, as every way to find a package reads it
    pkgs = homes.groupBy("pkg").agg(F.min("path").alias("dst"))
    i = imports.select("path", "import_path").distinct().join(homes.select("path"), "path", "left_semi")
    # a name finds its package whoever imports it, so that names are looked up once each, and only relative ones need their importer's directory
    asked = i.select("import_path").distinct()
    exact = asked.join(pkgs, F.col("import_path") == F.col("pkg")).select("import_path", "dst", F.lit(0).alias("r"), "pkg")
    parts = pkgs.where("pkg <> ''").withColumn("p", F.split("pkg", "[./]")).select("pkg", "dst", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.size("p"), F.lit(2))), lambda n: F.array_join(F.slice("p", n, F.size("p")), "."))).alias("tail")).where("tail <> ''")
    ending = asked.join(parts, F.col("import_path") == F.col("tail")).select("import_path", "dst", F.lit(1).alias("r"), "pkg")
    named = stored(exact.unionAll(ending).groupBy("import_path").agg(F.min(F.struct("r", "pkg", "dst"))["dst"].alias("dst")), "imported")
    found = i.join(named, "import_path").select(F.col("path").alias("src"), "dst")
    other = i.where("import_path LIKE './%' OR import_path LIKE '../%'").join(named, "import_path", "left_anti").select("path").distinct()
    relative = other.join(homes, "path").groupBy("path").agg(F.min("pkg").alias("pkg")).join(pkgs, "pkg").select(F.col("path").alias("src"), "dst")
    return found.unionAll(relative).distinct()


def cycles(edges: DataFrame, limit: int = MAX_CYCLES, files_each: int = MAX_CYCLE_FILES) -> DataFrame:
    """(component, members): strongly connected sets of (src, dst), in order."""
    got = strong_components(edges).groupBy("component").agg(F.slice(F.array_sort(F.collect_set("node")), 1, files_each).alias("members"))
    return got.orderBy("component").limit(limit)


def report(base: dict[str, DataFrame], top: int = TOP, semantics: Semantics = DEFAULT) -> dict[str, DataFrame | bool]:
    """All parts of the architecture report; ``truncated`` if dead code or cycles reach their caps."""
    files, symbols, calls = base["files"], base["symbols"], base["call_edges"]
    edges = calls.select(F.col("caller_id").alias("src"), F.col("callee_name").alias("dst"))
    if semantics.degree == "in":
        edges = calls.join(symbols.select("id", "name"), F.col("callee_name") == F.col("name")).select(F.col("caller_id").alias("src"), F.col("id").alias("dst"))
    out = {
        "counts": counts(files, symbols), "languages": by_count(files, "lang"), "packages": by_count(files, "pkg", TOP_PACKAGES),
        "hotspots": hotspots(symbols.dropDuplicates(["id"]), edges, top, semantics), "dead_code": dead_symbols(symbols, calls, semantics=semantics),
        "cycles": cycles(resolve_imports(base["imports"], files)),
    }
    return out | {"truncated": out["dead_code"].count() >= MAX_DEAD or out["cycles"].count() >= MAX_CYCLES}
