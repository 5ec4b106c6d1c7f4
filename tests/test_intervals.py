"""Attribution of hunks and lines to spans against comparing each with each."""

import random

import pytest
from sievework.operators import intervals, pattern
from sievework.semantics import Semantics


def _made(dice, n, rows):
    path = lambda: "big" if dice.random() < 0.5 else f"f{dice.randrange(4)}"
    spans = []
    for k in range(n):
        a = dice.randrange(rows)
        spans.append((path(), a, a + (dice.randrange(rows) if dice.random() < 0.1 else dice.randrange(12)), k // 2, f"s{k}"))
    hunks = [(path(), a, a + dice.choice([0, 1, 2, 9, 70]), k) for k in range(n) for a in [dice.randrange(rows + 20)]]
    return spans + [("big", 0, rows, 999, "whole")], hunks + [(None, 1, 2, -1), ("nowhere", 1, 2, -2)] + hunks[:2]


@pytest.mark.parametrize("width", [4, 256])
def test_attribution_equals_all_pairs(spark, monkeypatch, width):
    monkeypatch.setattr(intervals, "CELL", width)
    spans, hunks = _made(random.Random(width), 150, 200)
    s = spark.createDataFrame(spans, "path string, start_row int, end_row int, seq int, id string")
    h = spark.createDataFrame(hunks, "path string, start int, end int, tag int").repartition(3)
    got = sorted((r.path or "", r.start, r.end, r.tag, r.tier or 0, _seq(spans, r.id), r.id is None) for r in intervals.attribute(h, s, "path", ["id"]).collect())

    lost = intervals.attribute(spark.createDataFrame([("big", None, 3, 7)], h.schema), s, "path", ["id"]).first()
    assert (lost.tag, lost.tier, lost.id) == (7, None, None)

    def best(path, hs, he):
        found = []
        for p, a, b, seq, _ in spans:
            if p == path:
                overlap = min(he, b) - max(hs, a)
                tier = 1 if a <= hs and he <= b else 2 if a <= hs < b else 3 if overlap > 0 else 0
                if tier:
                    found.append((tier, -overlap if tier == 3 else b - a, seq))
        return min(found, default=(0, 0, None))

    assert got == sorted((p or "", a, b, t, best(p, a, b)[0], best(p, a, b)[2], best(p, a, b)[0] == 0) for p, a, b, t in hunks)


def _seq(spans, name):
    return next((s[3] for s in spans if s[4] == name), None)


@pytest.mark.parametrize("which", ["first", "smallest"])
def test_enclosing_equals_all_pairs(spark, monkeypatch, which):
    monkeypatch.setattr(intervals, "CELL", 8)
    spans, hunks = _made(random.Random(9), 120, 150)
    s = spark.createDataFrame(spans, "path string, start_row int, end_row int, seq int, id string")
    points = spark.createDataFrame([(p, a, t) for p, a, _, t in hunks], "path string, row int, tag int")

    def best(path, row):
        found = [((b - a, seq) if which == "smallest" else (seq,)) for p, a, b, seq, _ in spans if p == path and a <= row < b]
        return min(found)[-1] if found else None

    for how in ("left", "inner"):
        got = sorted((r.path or "", r.row, r.tag, str(_seq(spans, r.id))) for r in pattern.enclosing(points, s, "path", payload=["id"], how=how, semantics=Semantics(enclosing=which)).collect())
        assert got == sorted((p or "", a, t, str(best(p, a))) for p, a, _, t in hunks if how == "left" or best(p, a) is not None)


def test_a_file_with_half_of_all_rows_is_many_cells(spark):
    points = spark.range(60_000).selectExpr("'big' AS path", "CAST(id AS int) AS row")
    s = spark.range(15_000).selectExpr("'big' AS path", "CAST(id * 4 AS int) AS start_row", "CAST(id * 4 + 4 AS int) AS end_row", "CAST(id AS int) AS seq")
    out = pattern.enclosing(points, s, "path", payload=["seq"])
    assert out.where("seq = row DIV 4").count() == 60_000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "__cell" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
