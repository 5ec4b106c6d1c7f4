"""Strongly connected components against reachability and on graphs that no closure could hold."""

import random
from collections import defaultdict

import pytest
from sievework.operators import traverse


def _mutual(edges):
    """By search from every node."""
    out = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None:
            out[a].add(b)

    def reach(a):
        seen, left = set(), list(out[a])
        while left:
            v = left.pop()
            if v not in seen:
                seen.add(v)
                left += out[v]
        return seen

    nodes = {x for e in edges for x in e if x is not None}
    r = {v: reach(v) for v in nodes}
    return {v: min(w for w in r[v] if v in r[w]) for v in nodes if v in r[v]}


@pytest.mark.parametrize("one_task", [0, 9, 500_000])
def test_components_equal_mutual_reach(spark, one_task):
    dice = random.Random(one_task)
    for n, m in ((12, 14), (30, 45), (6, 0)):
        edges = [(f"n{dice.randrange(n):02d}", f"n{dice.randrange(n):02d}") for _ in range(m)]
        edges += edges[:3] + [(None, "n00"), ("n01", None), ("loop", "loop"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("c3", "tail"), ("head", "c1")] if m else []
        df = spark.createDataFrame([(*e, 1, "x") for e in edges], "src string, dst string, node int, colour string")
        got = traverse.strong_components(df, one_task).collect()
        assert {r.node: r.component for r in got} == _mutual(edges) and len(got) == len({r.node for r in got})


def test_a_hundred_thousand_nodes(spark):
    """One cycle of 50,000 nodes, 10,000 of three, and a star: a closure would have billions of rows."""
    ring = spark.range(50_000).selectExpr("id AS src", "(id + 1) % 50000 AS dst")
    small = spark.range(30_000).selectExpr("100000 + id AS src", "100000 + id - id % 3 + (id + 1) % 3 AS dst")
    star = spark.range(20_000).selectExpr("CAST(7 AS long) AS src", "200000 + id AS dst")
    got = traverse.strong_components(ring.unionAll(small).unionAll(star))
    sizes = got.groupBy("component").count().groupBy("count").count().collect()
    assert sorted(map(tuple, sizes)) == [(3, 10_000), (50_000, 1)]
    assert got.where("node = 49999 AND component = 0 OR node = 100005 AND component = 100003").count() == 2


def test_rounds_have_no_more_rows_than_edges(spark, monkeypatch):
    """Large shallow graphs are decided by colours alone."""
    made = []
    keep = traverse.stored

    def counted(df, tag):
        out = keep(df, tag)
        made.append((tag, out.count()))
        return out

    monkeypatch.setattr(traverse, "stored", counted)
    edges = spark.range(3000).selectExpr("id AS src", "id - id % 4 + (id + 1) % 4 AS dst").unionAll(spark.range(3000).selectExpr("id AS src", "id - 4 AS dst").where("dst >= 0 AND src % 40 <> 0"))
    got = traverse.strong_components(edges, one_task=100)
    assert got.groupBy("component").count().where("count = 4").count() == 750 and max(n for _, n in made) <= edges.count()


def test_paths_without_branches_take_no_coloured_rounds(spark, monkeypatch):
    monkeypatch.setattr(traverse, "_colours", lambda e: pytest.fail("coloured"))
    ring = [(k, (k + 1) % 40) for k in range(40)] + [(50 + k, 51 + k) for k in range(30)] + [(80, 3), (90, 91), (91, 90), (7, 90)]
    got = {tuple(r) for r in traverse.strong_components(spark.createDataFrame(ring, "src long, dst long"), 0).collect()}
    assert got == {(k, 0) for k in range(40)} | {(90, 90), (91, 90)}
