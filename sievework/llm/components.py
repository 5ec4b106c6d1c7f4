"""Connected components by alternating large and small stars, as joins and aggregates over an edge table.

Minima are pre-aggregated per task, and the edges of a hub meet its minimum by broadcast (``join_counted``), so that no task gets
all neighbours of one node. Each round's table replaces the last one's in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, drop, join_counted, stored


def _star(edges: DataFrame, large: bool, rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Link a node's larger (or not larger) neighbours to its smallest neighbour; also the table that this reads, if any."""
    if large:
        near = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    table = None
    if 2 * rows >= HOT_ROWS:  # with fewer edges no node is a hub
        least = table = stored(least, "minima")
    both = join_counted(near, least, "a", "n", 2 * rows)
    if large:
        out = both.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = both.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct(), table


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of the edges (a, b) of type long; component is the smallest node."""
    last, cur = None, stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        mark = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == last:
            break
        last, used = mark, [cur]
        for large in (True, False):
            cur, minima = _star(cur, large, mark[0])
            if minima is not None:
                cur = stored(cur, "stars")
                used += [minima, cur]
        if len(used) > 1:
            used.pop()
        else:
            cur = stored(cur, "stars")
        for t in used:
            drop(t)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(cur.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
