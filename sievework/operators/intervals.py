"""Half-open row intervals: merging, slicing and three-tier attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip

#: Rows of a file that spans and points are dealt out by.
CELL = 256


def merge(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of overlapping or adjacent intervals for each key; empty intervals survive where nothing touches them."""
    rows = df.select(*keys, F.col(start).alias("start"), F.col(end).alias("end"))
    w = W.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    runs = marked.withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def cell(row: Column) -> Column:
    return F.floor(row / F.lit(CELL)).cast("long")


def cells(first: Column, last: Column) -> Column:
    """The cells from row ``first`` to row ``last``."""
    return F.sequence(cell(first), cell(F.greatest(first, last)))


def attribute(hunks: DataFrame, spans: DataFrame, key: str, payload: list[str], start: str = "start_row", end: str = "end_row", order: str = "seq") -> DataFrame:
    """Each hunk (key, start, end) with its span: the smallest that holds it, else the smallest that holds its start, else the
    one that overlaps most; the first in ``order`` on ties; nulls if none does. Column ``tier`` says which rule it was.

    Hunks and spans meet in cells of ``CELL`` rows of a file, so a file with many of both is many small joins in as many tasks, not
    hunks times spans; a span has a row for each cell that it touches. A hunk's best span in each cell is kept while rows are joined, and the best of its cells after.
    """
    h = hunks.select(F.struct("*").alias("__h"), F.monotonically_increasing_id().alias("__n"), F.col(key).alias("__hkey"), F.col("start").alias("__hs"), F.col("end").alias("__he"))
    h = h.select("*", F.explode_outer(cells(F.col("__hs"), F.col("__he") - 1)).alias("__hcell"))
    s = spans.select(F.col(key).alias("__key"), F.col(start).alias("__s"), F.col(end).alias("__e"), F.col(order).alias("__o"), F.struct(*payload).alias("__p"))
    s = s.select("*", F.explode(cells(F.col("__s"), F.col("__e"))).alias("__cell"))
    hs, he, a, b = (F.col(c) for c in ("__hs", "__he", "__s", "__e"))
    overlap = F.least(he, b) - F.greatest(hs, a)
    tier = F.when((a <= hs) & (he <= b), 1).when((a <= hs) & (hs < b), 2).when(overlap > 0, 3)
    # what holds the hunk's start is found in its first cell; what begins later, in the cell where it begins
    here = (F.col("__hkey") == F.col("__key")) & (F.col("__hcell") == F.col("__cell")) & tier.isNotNull() & (F.col("__cell") == cell(F.greatest(hs, a)))
    rank = F.when(F.col("__key").isNotNull(), F.struct(tier.alias("tier"), F.when(tier == 3, -overlap).otherwise(b - a).alias("size"), F.col("__o").alias("order")))
    found = F.struct(tier.alias("tier"), F.col("__p").alias("p"))
    best = h.join(s, here, "left").groupBy("__n").agg(F.first("__h").alias("__h"), F.min_by(found, rank).alias("__best"))
    return best.select("__h.*", F.col("__best.tier").alias("tier"), "__best.p.*")


def slice_rows(text: Column, start: Column, end: Column) -> Column:
    """Rows [start, end) of a text, joined by line feeds; null for an empty range."""
    parts = F.split(text, "\n")
    return F.when(end > start, F.array_join(F.slice(parts, start + 1, end - start), "\n"))


def slice_with_trivia(text: Column, start: Column, end: Column) -> Column:
    """``slice_rows`` widened over the blank lines just before and after."""
    parts = F.split(text, "\n")
    blank = lambda x: strip(x) == ""
    before, after = F.reverse(F.slice(parts, F.lit(1), start)), F.slice(parts, end + 1, F.greatest(F.size(parts) - end, F.lit(0)))
    run = lambda a: F.coalesce(F.array_position(F.transform(a, lambda x: (~blank(x)).cast("int")), 1).cast("int") - 1, F.lit(-1))
    count = lambda a: F.when(run(a) < 0, F.size(a)).otherwise(run(a))
    a, b = start - count(before), end + count(after)
    return F.when(end > start, F.array_join(F.slice(parts, a + 1, b - a), "\n"))
