"""Finding symbols by name: globs, name paths, suggestions and scored search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import byte_distance, java_pattern, matches_glob, split_terms
from ..session import stored

SUGGEST_FROM, SUGGEST, SUGGEST_DISTANCE = 10_000, 3, 2
# The kinds of ids, and the kinds of nodes that a search may name.
ID_KINDS = ("repo", "pkg", "file", "class", "fn", "meth", "module")
NODE_KINDS = {"function": ("FUNCTION",), "method": ("METHOD",), "class": ("CLASS",), "module": ("MODULE",)}


def parse_name_path(path: str) -> tuple[str, str]:
    """(package, name): ``a/b/Name`` or ``kind:a.b.Name``; without separators the package is empty."""
    kind, sep, rest = path.partition(":")
    if sep and kind in ID_KINDS:
        path = rest
    if "/" in path:
        *front, name = [p for p in path.split("/") if p]
        return ".".join(front), name
    front, _, name = path.rpartition(".")
    return front, name


def find_symbol(symbols: DataFrame, name_path: str, kind: str | None = None, scope: str | None = None, limit: int | None = 20) -> DataFrame:
    """Symbols by a glob on the name (and, if given, the package), in order of path and place. Every symbol comes once."""
    pkg, name = parse_name_path(name_path)
    hit = symbols.where(matches_glob(F.col("name"), name))
    if pkg:
        hit = hit.where((F.col("pkg") == pkg) | (F.col("receiver") == pkg) | (F.concat_ws(".", "pkg", "receiver") == pkg))
    if kind:
        hit = hit.where(F.col("kind") == kind.upper())
    if scope:
        hit = hit.where(F.col("path").startswith(scope))
    out = hit.orderBy("path", "seq")
    return out.limit(limit) if limit else out


def suggest(names: DataFrame, name_col: str, wanted: str, top: int = SUGGEST, distance: int = SUGGEST_DISTANCE) -> DataFrame:
    """(name, distance): the nearest distinct names by byte edit distance, ties by name."""
    last = wanted.rpartition("/")[2].rpartition(".")[2]
    cand = names.select(F.col(name_col).alias("name")).where("name <> ''").distinct()
    return cand.withColumn("distance", byte_distance(F.col("name"), F.lit(last), distance)).where("distance >= 0").orderBy("distance", "name").limit(top)


def symbol_score(name: Column, doc: Column, path: Column, terms: list[str], pattern: str | None = None) -> Column:
    """The best signal of any term, then 0.15 for each term in the path, at most 1; null without a match.

    A term counts 0.9 if it is the name, 0.6 and up if the name holds it, 0.4 if the doc does, 0.25 if the path does,
    0.5 if only the pattern matches. Without terms the pattern alone gives 0.5.
    """
    low_name, low_doc, low_path = F.lower(name), F.lower(F.coalesce(doc, F.lit(""))), F.lower(path)
    by_pattern = F.lit(False)
    if pattern:
        regex = java_pattern(pattern)
        by_pattern = name.rlike(regex) | low_doc.rlike(regex) | low_path.rlike(regex)
    terms = [t for t in (x.strip().lower() for x in terms) if t]
    if not terms:
        return F.when(by_pattern & (name != ""), F.lit(0.5))
    signals = [
        F.when(low_name == t, F.lit(0.9))
        .when(F.contains(low_name, F.lit(t)), F.lit(0.6) + F.lit(0.1 * len(t.encode())) / F.octet_length(low_name))
        .when(F.contains(low_doc, F.lit(t)), F.lit(0.4))
        .when(F.contains(low_path, F.lit(t)), F.lit(0.25))
        .when(by_pattern, F.lit(0.5))
        for t in terms
    ]
    best = F.greatest(*signals) if len(signals) > 1 else signals[0]
    bonus = F.lit(0.0)
    for t in terms:
        bonus = bonus + F.when(F.contains(low_path, F.lit(t)), F.lit(0.15)).otherwise(F.lit(0.0))
    return F.when((name != "") & best.isNotNull(), F.least(best + bonus, F.lit(1.0)))


def search(symbols: DataFrame, terms: list[str] | str, kinds: list[str] | None = None, scope: str | None = None, pattern: str | None = None, limit: int | None = 10) -> DataFrame:
    """The symbols and their score, best first; ties by path, then by place. Kind and scope are tested before scoring."""
    terms = split_terms(terms) if isinstance(terms, str) else terms
    rows = symbols
    if scope:
        rows = rows.where(F.col("path").startswith(scope))
    if kinds:
        rows = rows.where(F.col("kind").isin([k for x in kinds for k in NODE_KINDS.get(x.lower(), (x.upper(),))]))
    hits = rows.withColumn("score", symbol_score(F.col("name"), F.col("doc"), F.col("path"), terms, pattern)).where("score IS NOT NULL")
    return hits.orderBy(F.desc("score"), "path", "seq").limit(limit) if limit else hits


def resolve(symbols: DataFrame, name_path: str) -> DataFrame:
    """Symbols that an id or a name path stands for, best reading first (column ``reading``), with ``ambiguous`` = how many."""
    pkg, name = parse_name_path(name_path)
    readings = list(dict.fromkeys([pkg.rpartition(".")[0], pkg, ""] if "." in pkg else [pkg, ""]))
    # a symbol has its best reading, so one scan finds all that any reading fits; the few of them are kept
    reading = F.when(F.col("id") == name_path, 0)
    for n, p in enumerate(readings, 1):
        reading = reading.when((F.col("name") == name) & (F.lit(True) if p == "" else F.col("pkg") == p), n)
    fits = stored(symbols.withColumn("reading", reading).where("reading IS NOT NULL"), "readings")
    first = fits.agg(F.min("reading").alias("r"))
    best = fits.join(F.broadcast(first), F.col("reading") == F.col("r")).drop("r")
    count = best.agg(F.count("*").alias("ambiguous"))  # one row
    return best.join(F.broadcast(count)).orderBy("path", "seq")
