"""Pattern search over lines, with the enclosing declaration, grouped and ranked by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import java_pattern, path_passes_glob, snippet
from ..semantics import DEFAULT, Semantics
from .intervals import cell, cells

LIMIT, SCAN = 50, 16
# Endings of test files.
TEST_ENDINGS = ("_test.go", ".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx", "_test.py", "_test.rs", "Test.php")


def lines_of(files: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, row, text): lines from row 0; an empty text has none, and one empty last line is left out."""
    parts = F.split(F.col(text_col), "\n")
    kept = F.when(F.col(text_col) == "", F.array().cast("array<string>")).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return files.select(*keys, F.posexplode(kept).alias("row", "text"))


def find_lines(lines: DataFrame, pattern: str, scope: str | None = None, file_glob: str | None = None) -> DataFrame:
    """Lines that match, one row a line. Scope (a prefix of the path) and glob are tested first."""
    hit = lines.where(F.col("text").rlike(java_pattern(pattern)))
    if scope:
        hit = hit.where(F.col("path").startswith(scope))
    if file_glob:
        hit = hit.where(path_passes_glob(F.col("path"), file_glob))
    return hit.withColumn("snippet", snippet(F.col("text")))


def enclosing(points: DataFrame, spans: DataFrame, key: str, point: str = "row", start: str = "start_row", end: str = "end_row", order: str = "seq", payload: list[str] | None = None, how: str = "left", semantics: Semantics = DEFAULT) -> DataFrame:
    """Each point with the span around it: the first in ``order``, or the smallest. Points and spans meet in cells of a file's rows; see ``intervals.attribute``."""
    payload = payload or [c for c in spans.columns if c not in (key, start, end, order)]
    p = points.select(F.struct("*").alias("__p"), F.monotonically_increasing_id().alias("__n"), F.col(key).alias("__pkey"), F.col(point).alias("__row"), cell(F.col(point)).alias("__pcell"))
    s = spans.select(F.col(key).alias("__key"), F.col(start).alias("__start"), F.col(end).alias("__end"), F.col(order).alias("__order"), F.struct(*payload).alias("__payload")).where("__start < __end")
    s = s.select("*", F.explode(cells(F.col("__start"), F.col("__end") - 1)).alias("__cell"))
    inside = (F.col("__pkey") == F.col("__key")) & (F.col("__pcell") == F.col("__cell")) & (F.col("__start") <= F.col("__row")) & (F.col("__row") < F.col("__end"))
    rank = F.struct("__order") if semantics.enclosing == "first" else F.struct((F.col("__end") - F.col("__start")).alias("size"), "__order")
    best = p.join(s, inside, how).groupBy("__n").agg(F.first("__p").alias("__p"), F.min_by("__payload", F.when(F.col("__key").isNotNull(), rank)).alias("__best"))
    return best.select("__p.*", "__best.*")


def find_code(lines: DataFrame, symbols: DataFrame, pattern: str, scope: str | None = None, file_glob: str | None = None, limit: int = LIMIT, include_context: bool = False) -> DataFrame:
    """Matches in order of path and row, at most 16 times ``limit`` of them (what a search looks at)."""
    hit = find_lines(lines, pattern, scope, file_glob).orderBy("path", "row").limit(SCAN * limit)
    return enclosing(hit, symbols, "path", payload=["id", "kind", "name"]) if include_context else hit


def is_test_file(path: Column) -> Column:
    out = F.lit(False)
    for e in TEST_ENDINGS:
        out = out | path.endswith(e)
    return out


def bucket(path: Column, kind: Column) -> Column:
    """0 for definitions, 1 for what is merely popular, 2 for test files."""
    return F.when(is_test_file(path), 2).when(kind.isin("FUNCTION", "METHOD", "CLASS", "MODULE"), 0).otherwise(1)


def group_matches(matches: DataFrame, degree: DataFrame | None = None, keys: tuple[str, ...] = ("id", "kind", "path", "name")) -> DataFrame:
    """Matches grouped by their enclosing declaration: hits (row, snippet) in order, match_count, bucket, fan_in, ranked.

    ``degree`` has (name, fan_in). Matches outside any declaration are left out.
    """
    got = matches.where("id IS NOT NULL").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", "snippet"))).alias("hits"), F.count("*").alias("match_count"))
    got = got.withColumn("bucket", bucket(F.col("path"), F.col("kind")))
    got = got.withColumn("fan_in", F.lit(0).cast("long")) if degree is None else got.join(degree, "name", "left").withColumn("fan_in", F.coalesce("fan_in", F.lit(0)).cast("long"))
    return got.orderBy("bucket", F.desc("match_count"), F.desc("fan_in"), "id")


def search_code(lines: DataFrame, symbols: DataFrame, calls: DataFrame, pattern: str, scope: str | None = None, file_glob: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Ranked declarations around the matches, at most ``limit``."""
    matches = find_code(lines, symbols, pattern, scope, file_glob, limit, include_context=True)
    fan_in = calls.groupBy(F.col("callee_name").alias("name")).agg(F.count("*").alias("fan_in"))
    return group_matches(matches, fan_in).limit(limit)
