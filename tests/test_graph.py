import pytest
from pyspark.sql import functions as F
from sievework.operators import architecture, edges, intervals, traverse
from sievework.semantics import Semantics


@pytest.fixture(scope="module")
def rel(spark):
    calls = [("Alpha", "Charge"), ("Auth", "Charge"), ("Refresh", "Charge"), ("Beta", "Refund")]
    down = spark.createDataFrame(calls, "src string, dst string")
    return {"callees": down, "callers": down.select(F.col("dst").alias("src"), F.col("src").alias("dst"))}


def _rows(t):
    return [(r.target, r.depth, r.via, r.score) for r in t.rows.collect()]


def test_follow_cycles_by_step_and_seeds_are_not_emitted(rel):
    t = traverse.traverse(rel, traverse.normalise_seeds("Alpha"), ["callees", "callers"], 2)
    assert _rows(t) == [("Charge", 1, ["callees"], 0.5), ("Auth", 2, ["callers"], 1 / 3), ("Refresh", 2, ["callers"], 1 / 3)]
    assert not t.truncated and t.visited == 2


def test_weights(rel):
    t = traverse.traverse(rel, traverse.normalise_seeds(seeds=["Alpha", "Auth"], weights=[0.8, 0.2]), ["callees"], 1)
    assert _rows(t) == [("Charge", 1, ["callees"], 0.4)]
    assert {r.seed: r.score for r in t.seed_scores.collect()} == {"Alpha": 0.4, "Auth": 0.1}


def test_limit_and_filter(rel):
    t = traverse.traverse(rel, traverse.normalise_seeds(seeds=["Alpha", "Beta"]), ["callees"], 1, limit=1)
    assert len(_rows(t)) == 1 and t.truncated
    t = traverse.traverse(rel, traverse.normalise_seeds("Alpha"), ["callees", "callers"], 2, keep=F.col("dst") == "Auth")
    assert [r[0] for r in _rows(t)] == ["Auth"]


def test_later_heavier_seed_improves_a_row(spark):
    e = spark.createDataFrame([("light", "x"), ("heavy", "m"), ("m", "x")], "src string, dst string")
    t = traverse.traverse({"e": e}, traverse.normalise_seeds(seeds=["light", "heavy"], weights=[0.1, 1.0]), ["e"], 2)
    assert {r[0]: (r[1], pytest.approx(r[3])) for r in _rows(t)} == {"m": (1, 0.5), "x": (1, 1 / 3)}


def test_seed_rules():
    got = traverse.normalise_seeds(seeds=["a", "b", "a"], weights=[0.1, 0.5, 0.9])
    assert [(s.id, s.weight) for s in got] == [("a", 0.9), ("b", 0.5)]
    for bad in ({}, {"start": "a", "seeds": ["b"]}, {"seeds": ["a"], "weights": [1.0, 2.0]}, {"seeds": [str(i) for i in range(51)]}):
        with pytest.raises(ValueError):
            traverse.normalise_seeds(**bad)


def test_argument_checks(rel):
    for args in (["callees"], 6), (["nope"], 1), ([], 1):
        with pytest.raises(ValueError):
            traverse.traverse(rel, traverse.normalise_seeds("Alpha"), *args)


def test_strong_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e"), ("f", "g")], "src string, dst string")
    assert {(r.node, r.component) for r in traverse.strong_components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("e", "e")}
    assert [(r.component, r.members) for r in architecture.cycles(e).collect()] == [("a", ["a", "b", "c"]), ("e", ["e"])]


def test_merge_keeps_empty_intervals_and_is_idempotent(spark):
    df = spark.createDataFrame([("k", 10, 15), ("k", 5, 8), ("k", 14, 20), ("k", 25, 25)], "k string, start int, end int")
    once = intervals.merge(df, ["k"])
    want = [(5, 8), (10, 20), (25, 25)]
    assert [(r.start, r.end) for r in once.orderBy("start").collect()] == want
    assert [(r.start, r.end) for r in intervals.merge(once, ["k"]).orderBy("start").collect()] == want


def test_three_tiers(spark):
    spans = spark.createDataFrame([("f", 5, 10, 0, "first"), ("f", 10, 30, 1, "second"), ("f", 12, 14, 2, "inner")], "path string, start_row int, end_row int, seq int, id string")
    hunks = spark.createDataFrame([("f", 12, 13), ("f", 8, 12), ("f", 0, 12), ("f", 0, 3), ("f", 2, 25), ("g", 1, 2)], "path string, start int, end int")
    got = {(r.path, r.start, r.end): (r.tier, r.id) for r in intervals.attribute(hunks, spans, "path", ["id"]).collect()}
    assert got == {("f", 12, 13): (1, "inner"), ("f", 8, 12): (2, "first"), ("f", 0, 12): (3, "first"), ("f", 0, 3): (None, None), ("f", 2, 25): (3, "second"), ("g", 1, 2): (None, None)}


def test_slices(spark):
    df = spark.createDataFrame([("a\n\nb\nc\n\n \nd",)], "t string")
    r = df.select(intervals.slice_rows(F.col("t"), F.lit(2), F.lit(4)).alias("x"), intervals.slice_rows(F.col("t"), F.lit(2), F.lit(2)).alias("none"), intervals.slice_with_trivia(F.col("t"), F.lit(2), F.lit(4)).alias("y")).first()
    assert r.x == "b\nc" and r.none is None and r.y == "\nb\nc\n\n "


def test_degree_switch(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "src string, dst string")
    assert [(r.id, r.degree) for r in architecture.hotspots(nodes, e).collect()] == [("a", 2), ("b", 1)]
    assert [(r.id, r.degree) for r in architecture.hotspots(nodes, e, semantics=Semantics(degree="in")).collect()] == [("c", 2), ("b", 1)]
    assert [r.id for r in architecture.dead(nodes, e).collect()] == ["c"]
    assert [r.id for r in architecture.dead(nodes, e, semantics=Semantics(degree="in")).collect()] == ["a"]


def test_caps_per_kind(spark):
    e = spark.createDataFrame([("K", f"t{i}") for i in range(9)] + [("L", "t")], "edge_kind string, target_id string")
    kept, counts = edges.cap_per_kind(e, 2)
    assert kept.count() == 3
    assert {(r.edge_kind, r.total_count, r.truncated) for r in counts.collect()} == {("K", 8, True), ("L", 1, False)}


def test_calls_are_dealt_by_their_number(spark, sf_dir, monkeypatch):
    from sievework.plans import graph_queries

    monkeypatch.setattr(graph_queries, "ROWS_A_TASK", 500)
    n = -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 500)
    assert n > 4 and graph_queries._base(spark, sf_dir)["call_edges"].rdd.getNumPartitions() == n  # before, as many as Spark's setting, or fewer
    for name in "graph_callers", "graph_callees":
        plan = graph_queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert f", {n}), REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
        assert not [x for x in plan.split("\n") if "Exchange" in x and "location" in x]  # edges are put together last


def test_edges_by_many_tasks(spark):
    s = spark.createDataFrame([(f"fn:p{k % 3}.f{k % 5}", f"f{k % 5}", "FUNCTION", f"s{k}", f"p{k % 3}", f"/{k}.go", k, k + 1) for k in range(30)], "id string, name string, kind string, summary string, pkg string, path string, start_row int, end_row int")
    c = s.select("path", F.col("id").alias("caller_id"), F.col("start_row").alias("caller_start_row"), F.concat(F.lit("f"), (F.col("start_row") % 7).cast("string")).alias("callee_name"))
    key = lambda e: sorted((r.source_id, r.target_id, r.location) for r in e.collect())
    assert key(edges.callers(s, c, tasks=9)) == key(edges.callers(s, c)) and key(edges.callees(s, c, tasks=9))
    assert {(r.source_id, r.target_id) for r in edges.callees(s, c, 9).collect()} == {(r.source_id, r.target_id) for r in edges.callees(s, c).collect()}
    one = edges.callers(s, c, only=s.where("path = '/3.go'").select("id"))
    assert key(one) == [x for x in key(edges.callers(s, c)) if x[0] == "fn:p0.f3"] != []
