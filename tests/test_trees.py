"""Nested patterns against all embeddings, and node tables of pages."""

import random

import pytest
from sievework.operators import ast_query, trees
from sievework.plans import bindings
from sievework.sources import markup


def _children(rows):
    """Children of every place by comparing all spans; rows are (start, stop, type, text) in document order."""
    inside = lambda a, b: a != b and rows[b][0] <= rows[a][0] and rows[a][1] <= rows[b][1] and (rows[a][:2] != rows[b][:2] or a > b)
    n = range(len(rows))
    above = {a: [b for b in n if inside(a, b)] for a in n}
    parent = {a: max(above[a], default=None) for a in n}
    return {p: [a for a in n if parent[a] == p] for p in [None, *n]}, above


def _embeddings(q, v, rows, children, above, tests):
    """All matches of ``q`` at place v, as lists of (capture, place)."""
    if any(name in q.captures and not ok(rows[v][3]) for name, ok in tests):
        return
    if q.options:
        for o in q.options:
            for e in _embeddings(o, v, rows, children, above, tests):
                yield e + [(c, v) for c in q.captures]
        return
    if q.type not in ("_", rows[v][2]):
        return

    def ordered(left, places):
        if not left:
            yield []
            return
        for k, w in enumerate(places):
            for e in _embeddings(left[0], w, rows, children, above, tests):
                for rest in ordered(left[1:], places[k + 1 :]):
                    yield e + rest

    def deep(left):
        if not left:
            yield []
            return
        for w in range(len(rows)):
            if v in above[w]:
                for e in _embeddings(left[0], w, rows, children, above, tests):
                    for rest in deep(left[1:]):
                        yield e + rest

    for a in ordered(q.children, children[v]):
        for b in deep(q.below):
            yield a + b + [(c, v) for c in q.captures]


PATTERNS = {
    "(a (b) @x (c) @y) @z": [],
    "(a ..(b (c) @c) @b)": [],
    "(_ (b) @p (_) @q (b) @r)": [],
    "([(a) (b (c))] @x)": None,
    '(a ..(b) @x ..(c) @y (#eq? @x "t1") (#not-eq? @y "t0"))': [("x", lambda t: t == "t1"), ("y", lambda t: t is not None and t != "t0")],
    '[(a (b) @x) (c ..(b) @y)] @z (#any-of? @z "t0" "t2")': [("z", lambda t: t in ("t0", "t2"))],
    '(a ..(_ (a) @x) (b (a) @y) (#match? @x "[12]$"))': [("x", lambda t: t is not None and t[-1] in "12")],
}


def _random_tree(dice, n):
    rows = []

    def grow(a, depth):
        at = a + 1
        me = len(rows)
        rows.append(None)
        while len(rows) < n and dice.random() < (0.8 if depth < 3 else 0.5):
            at = grow(at, depth + 1)
        rows[me] = (a, at, dice.choice("abc"), dice.choice(["t0", "t1", "t2", None]))
        return at

    at = 0
    while len(rows) < n:
        at = grow(at, 0)
    return rows


@pytest.mark.parametrize("in_order", [False, True])
def test_patterns_equal_all_embeddings(spark, monkeypatch, in_order):
    monkeypatch.setattr(trees, "ROWS", 12)  # several blocks, and trees larger than one
    dice = random.Random(7)
    forest = {t: _random_tree(dice, dice.choice([1, 4, 9, 14])) for t in range(60)}
    rows = [(t, a, z, kind, text, "k") for t, tree in forest.items() for a, z, kind, text in tree]
    if not in_order:
        dice.shuffle(rows)
        rows += [(None, 0, 1, "a", "t1", "k"), (3, None, 4, "b", "t1", "k"), (3, 1, None, "b", "t1", "k")]
    nodes = spark.createDataFrame(rows, "tree long, start int, stop int, node_type string, text string, capture_ string")
    if in_order:
        nodes = nodes.coalesce(1)
    good = {p: tests for p, tests in PATTERNS.items() if tests is not None}
    got = {(r.pattern, r.tree, r.capture, r.start) for r in trees.match_all(nodes, {p: p for p in good}, in_order).collect()}
    want = set()
    for p, tests in good.items():
        root = trees.parse(p).root
        for t, tree in forest.items():
            children, above = _children(tree)
            for v in range(len(tree)):
                for e in _embeddings(root, v, tree, children, above, tests):
                    want.update((p, t, c, tree[w][0]) for c, w in e)
    assert got == want and {p for p, *_ in want} == set(good)


def test_bad_patterns(spark):
    nodes = spark.createDataFrame([(1, 0, 1, "a")], "tree long, start int, stop int, node_type string")
    for bad in [p for p, t in PATTERNS.items() if t is None] + ["", "(a)", "(a @x", "(a) @x)", "() @x", "(a ..) @x", "[] @x", "(a) @x (#gone? @x \"1\")", '(a) @x (#eq? @y "1")', "(a) @x (#eq? @x)", '(a) @x (#eq? @x "1" "2")', "(a) @x (#eq? @x @x)", "$", "(a) @x" + " " * 5000]:
        with pytest.raises(ValueError):
            trees.parse(bad)
    for missing in ('(a) @x (#eq? @x "1")', "(a name: (b) @x)"):
        with pytest.raises(ValueError):
            trees.match(nodes, missing)
    assert trees.match(nodes.where("false"), "(a) @x").collect() == [] and trees.match(nodes, "(a) @x").columns == [*nodes.columns, "capture"]


def test_one_capture_row_where_pairs_grow_with_the_square(spark):
    n = 3000
    rows = [(1, 0, 2 * n + 1, "ul")] + [(1, k, k + 1, "li") for k in range(1, 2 * n + 1)]
    nodes = spark.createDataFrame(rows, "tree long, start int, stop int, node_type string")
    assert {r.capture: r["count"] for r in trees.match(nodes, "(ul (li) @a (li) @b)").groupBy("capture").count().collect()} == {"a": 2 * n - 1, "b": 2 * n - 1}
    deep = spark.createDataFrame([(1, k, 2 * n - k, "div") for k in range(n)], "tree long, start int, stop int, node_type string")
    assert {r.capture: r["count"] for r in trees.match(deep, "(div ..(div) @b) @a").groupBy("capture").count().collect()} == {"a": n - 1, "b": n - 1}


def test_fields_overlaps_and_equal_spans(spark):
    rows = [(1, 0, 9, 0, "f", None), (1, 0, 9, 1, "g", "body"), (1, 5, 20, 0, "h", "name"), (1, 9, 12, 0, "i", None)]
    nodes = spark.createDataFrame(rows, "tree long, start int, stop int, level int, node_type string, field string")
    assert [r.start for r in trees.match(nodes, "(f body: (g name: (h) @x))").collect()] == [5]  # h is cut at 9, so i is no part of it
    assert trees.match(nodes, "(h (i) @x)").collect() == [] and trees.match(nodes, "(f name: (g) @x)").collect() == []


def test_elements_of_pages():
    page = "<!-- <p> --><P class=a>one<br>two<b>three</i></p><script>if (a<b) '<p>'</script><img src=x /><ul><li>x<li>y</ul>z</div>"
    assert [tuple(e) for e in markup.elements(page)] == [
        (0, 4, "p", "class=a", "one"), (1, 2, "br", "", "two"), (2, 4, "b", "", "three"), (5, 6, "script", "", ""), (6, 7, "img", "src=x", ""),
        (7, 10, "ul", "", ""), (8, 10, "li", "", "x"), (9, 10, "li", "", "y"),
    ]


def test_pages_of_one_id_stay_apart_and_empty_ones_have_no_nodes(spark, monkeypatch):
    monkeypatch.setattr(markup, "ROWS", 3)
    page = "<div><p>a</p><p>b</p></div>"
    pages = spark.createDataFrame([(1, page, "x"), (1, page, "x"), (2, None, "x"), (3, "", "x"), (None, page, "x"), (4, "plain", "x"), (5, "<a>" * 10_000, "x")], "page_id long, html string, text string")
    nodes = markup.nodes(pages, "page_id", "html")
    assert nodes.groupBy("page_id").count().orderBy("page_id").collect() == [(None, 3), (1, 6), (5, 10_000)]
    stored = spark.createDataFrame(nodes.collect(), nodes.schema)
    for table, in_order in ((nodes, True), (stored, False)):
        got = trees.match(table, "(div (p) @a (p) @b)", in_order)
        assert sorted((r.page_id or 0, r.capture, r.text) for r in got.collect()) == [(0, "a", "a"), (0, "b", "b")] + [(1, "a", "a")] * 2 + [(1, "b", "b")] * 2
    assert markup.nodes(pages.where("false"), "page_id", "html").count() == 0


def test_nested_patterns_over_code(spark):
    symbols = spark.createDataFrame([("f.py", 0, 10, "class_definition", "A", ""), ("f.py", 1, 4, "function_definition", "go", "A"), ("f.py", 5, 9, "function_definition", "stop", "A"), ("g.py", 0, 3, "function_definition", "go", "")], "path string, start_row int, end_row int, grammar_kind string, name string, receiver string")
    calls = spark.createDataFrame([("f.py", 2, "close"), ("f.py", 6, "open"), ("g.py", 1, "close")], "path string, row int, callee_name string")
    got = ast_query.query(symbols, calls, '(class_definition (function_definition ..(call_expression) @c (#eq? @c "close")) @f)')
    assert [tuple(r) for r in got.collect()] == [("f.py", 1, 4, "function_definition", "f", "go"), ("f.py", 2, 3, "call_expression", "c", "close")]
    assert ast_query.query(symbols, calls, "(function_definition name: (identifier) @n)").count() == 3  # one node stays as it was


def test_match_in_order_needs_no_shuffle(spark, sf_dir):
    plan = bindings.QUERIES["tree_patterns"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Exchange" not in plan
    nodes = spark.createDataFrame([(1, 0, 1, "a")], "tree long, start int, stop int, node_type string")
    assert trees.match(nodes, "(a) @x")._jdf.queryExecution().executedPlan().toString().count("Sort ") == 1
