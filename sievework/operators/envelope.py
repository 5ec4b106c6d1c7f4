"""Answers with their envelope: the rows within the limit, how many there are, and whether some were left out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import names, pattern
from .intervals import slice_rows


@dataclass
class Answer:
    """``total`` counts what was looked at: it never exceeds the scan's own limit."""

    rows: DataFrame
    total: int
    truncated: bool
    limit: int
    suggestions: DataFrame | None = None


def _answer(hits: DataFrame, order: list[Column | str], limit: int, scan: int) -> Answer:
    """The first ``limit`` of at most ``scan`` hits, which are found once."""
    seen = stored(hits.orderBy(*order).limit(scan), "hits")
    total = seen.count()
    return Answer(seen.orderBy(*order).limit(limit), total, total > limit, limit)


def find_code(lines: DataFrame, symbols: DataFrame, text: str, scope: str | None = None, file_glob: str | None = None, limit: int = pattern.LIMIT, include_context: bool = False) -> Answer:
    """Matching lines in order of path and row; a search looks at 16 times the limit."""
    got = _answer(pattern.find_lines(lines, text, scope, file_glob), ["path", "row"], limit, pattern.SCAN * limit)
    if include_context:
        got.rows = pattern.enclosing(got.rows, symbols, "path", payload=["id", "kind", "name"]).orderBy("path", "row")
    return got


def search_code(lines: DataFrame, symbols: DataFrame, calls: DataFrame, text: str, scope: str | None = None, file_glob: str | None = None, limit: int = pattern.LIMIT) -> Answer:
    """Ranked declarations around the matches; the total is at most 4 times the limit."""
    found = pattern.find_code(lines, symbols, text, scope, file_glob, limit, include_context=True)
    fan_in = calls.groupBy(F.col("callee_name").alias("name")).agg(F.count("*").alias("fan_in"))
    return _answer(pattern.group_matches(found, fan_in), ["bucket", F.desc("match_count"), F.desc("fan_in"), "id"], limit, 4 * limit)


def search(symbols: DataFrame, terms: list[str] | str, kinds: list[str] | None = None, scope: str | None = None, limit: int = 10) -> Answer:
    """Scored symbols, best first; the total is at most 4 times the limit."""
    return _answer(names.search(symbols, terms, kinds, scope, limit=None), [F.desc("score"), "path", "seq"], limit, 4 * limit)


def find_symbol(symbols: DataFrame, name_path: str, files: DataFrame | None = None, kind: str | None = None, scope: str | None = None, limit: int = 20, include_body: bool = False) -> Answer:
    """Symbols by a glob on the name; with their source (column ``body``) on demand, and with near names if there is none."""
    got = _answer(names.find_symbol(symbols, name_path, kind, scope, None), ["path", "seq"], limit, 4 * limit)
    if include_body:
        if files is None:
            raise ValueError("bodies need the files")
        whole = files.select("path", F.col("text").alias("whole"))
        got.rows = got.rows.join(whole, "path", "left").withColumn("body", slice_rows(F.col("whole"), F.col("start_row"), F.col("end_row"))).drop("whole").orderBy("path", "seq")
    if not got.total:
        got.suggestions = names.suggest(symbols.limit(names.SUGGEST_FROM), "name", names.parse_name_path(name_path)[1])
    return got
