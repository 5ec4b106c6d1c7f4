import re

import pytest
from sievework.plans import bindings, code_queries, graph_queries

from .oracle import compare, connect


QUERIES, SQL = bindings.QUERIES | graph_queries.QUERIES | code_queries.QUERIES, bindings.SQL | graph_queries.SQL | code_queries.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    compare(QUERIES[name](spark, sf_dir), SQL[name], connect(sf_dir))


@pytest.mark.parametrize("name", sorted(set(bindings.QUERIES) - set(bindings.SQL)))
def test_query_runs(spark, sf_dir, name):
    assert bindings.QUERIES[name](spark, sf_dir).count() > 0


def test_all_code_queries_are_registered():
    import __spark_entry__ as entry

    assert set(code_queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_snippets_of_all_lines(spark, sf_dir):
    cut = lambda b: b.decode() if len(b) <= 200 else b[:200].decode("utf-8", "replace") + "…"
    hits = [r for r in bindings.QUERIES["lines"](spark, sf_dir).collect() if r.path.startswith("src1") and r.path.split("/")[1].startswith("e") and re.search(bindings.RE, r.text)]
    assert any(len(r.text.encode()) > 200 for r in hits)
    got = bindings.QUERIES["regex_lines"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted((r.path, r.row, cut(r.text.encode())) for r in hits)


def test_every_line_order_and_part_is_judged(spark, sf_dir):
    con = connect(sf_dir)
    tiers = {r.tier for r in bindings.QUERIES["three_tier"](spark, sf_dir).select("tier").distinct().collect()}
    assert tiers == {1, 2, 3, None} and bindings.QUERIES["three_tier"](spark, sf_dir).count() == bindings.QUERIES["lines"](spark, sf_dir).count()
    assert bindings.QUERIES["edges_per_kind"](spark, sf_dir).count() == con.sql("SELECT 2 * count(DISTINCT l_orderkey) FROM lineitem JOIN orders ON o_orderkey = l_orderkey").fetchall()[0][0]
    assert bindings.QUERIES["rename_conflicts"](spark, sf_dir).count() == con.sql("SELECT count(*) FROM part").fetchall()[0][0]


def test_no_query_proves_nothing(sf_dir):
    con = connect(sf_dir)
    rows = {n: con.sql(q).fetchall() for n, q in SQL.items()}
    assert [n for n, r in rows.items() if not r] == []
    depth = lambda n: {r[4] for r in rows[n]}
    assert len(rows["traverse_depth5"]) > len(rows["traverse_depth1"]) and max(depth("traverse_depth5")) == 5 and depth("traverse_cycle_follow") >= {1, 2, 3} and len(rows["traverse_row_cap"]) == 40
