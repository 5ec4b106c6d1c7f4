"""Graph, diff, chunk and layer operators bound to relations that are made of the driver's tables, with their DuckDB SQL.

The relations (symbols, calls, imports, parents, files) are written once in SQL that both engines read; what the operators do with
them is written twice. Orders and parts play symbols, line items play calls, customers play files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_embedding, tokens
from ..operators import architecture, changes, chunks, edges, names, pattern, retrieve, tree
from ..semantics import Semantics
from ..sources.extract import resolve_receivers
from .bindings import _BM25, QUERY_TEXT, _t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TABLES = ("customer", "documents", "lineitem", "nation", "orders", "part", "supplier")

_FILE = "'c' || {c} || CASE WHEN {c} % 10 = 0 THEN '_test.go' ELSE '.go' END"
SYMBOLS = f"""SELECT 'class:' || p_brand || '.p' || p_partkey AS id, 'CLASS' AS kind, 'class' AS id_kind, 'type_declaration' AS grammar_kind, 'p' || p_partkey AS name, p_brand AS pkg, '' AS receiver,
 p_type || '/' || p_brand || CASE WHEN p_size % 10 = 0 THEN '_test.go' ELSE '.go' END AS path, 'php' AS lang, p_partkey AS seq, CAST(p_partkey * 10 AS INT) AS start_row, CAST(p_partkey * 10 + 8 AS INT) AS end_row FROM {{part}}
UNION ALL SELECT CASE WHEN o_orderstatus = 'F' THEN 'fn:c' || o_custkey || '.o' || o_orderkey ELSE 'meth:c' || o_custkey || '.k' || o_custkey || '.o' || o_orderkey END,
 CASE WHEN o_orderstatus = 'F' THEN 'FUNCTION' ELSE 'METHOD' END, CASE WHEN o_orderstatus = 'F' THEN 'fn' ELSE 'meth' END, CASE WHEN o_orderstatus = 'F' THEN 'function_declaration' ELSE 'method_declaration' END,
 'o' || o_orderkey, 'c' || o_custkey, CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'k' || o_custkey END, {_FILE.format(c="o_custkey")}, 'go', o_orderkey, CAST(o_orderkey * 5 AS INT), CAST(o_orderkey * 5 + 4 AS INT) FROM {{orders}}
UNION ALL SELECT 'class:c' || c_custkey || '.k' || c_custkey, 'CLASS', 'class', 'type_declaration', 'k' || c_custkey, 'c' || c_custkey, '', {_FILE.format(c="c_custkey")}, 'go', 0, 0, 3 FROM {{customer}}"""
CALLS = f"""SELECT DISTINCT s.path, s.pkg, s.id AS caller_id, s.name AS caller_name, s.receiver AS caller_receiver, s.start_row AS caller_start_row,
 CASE WHEN l_linenumber = 1 THEN 'o' || l_orderkey WHEN l_linenumber = 2 THEN 'o' || (l_orderkey % 100) ELSE 'p' || l_partkey END AS callee_name
FROM {{lineitem}} JOIN ({SYMBOLS}) s ON s.name = 'o' || l_orderkey"""
IMPORTS = f"""SELECT path, 's' || (l_suppkey % 5) AS import_path, CAST(min(l_linenumber) AS INT) AS start_row, CAST(max(l_linenumber) + 1 AS INT) AS end_row
FROM {{lineitem}} JOIN ({SYMBOLS}) s ON s.name = 'o' || l_orderkey GROUP BY path, l_suppkey % 5"""
METHODS = """SELECT 'meth:n' || (o_custkey % 25) || '.k' || o_custkey || '.' || o_orderkey AS id, 'METHOD' AS kind, 'Method: m' || (o_orderkey % 7) AS summary, 'm' || (o_orderkey % 7) AS name, 'n' || (o_custkey % 25) AS path,
 'k' || o_custkey AS receiver, CAST(o_orderkey AS INT) AS start_row, CAST(o_orderkey + 2 AS INT) AS end_row FROM {orders}"""
INHERITS = "SELECT 'n' || (c_custkey % 25) AS path, 'k' || c_custkey AS class_name, 'k' || (c_custkey + 25) AS parent_name FROM {customer}"
_DUCK = {t: t for t in TABLES}
_S, _C, _I = (f"{n} AS ({x.format(**_DUCK)})" for n, x in (("sym", SYMBOLS), ("calls", CALLS), ("imp", IMPORTS)))
_FLAT = "edge_kind, source_id, target_id, target_kind, file, \"start\", \"end\", confidence"


def _made(spark: SparkSession, d: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: _t(spark, d, t) for t in TABLES if "{" + t + "}" in sql})


#: Rows of calls that a task gets: its sorts and counts stay at some 100 MB, whatever the size of the tables.
ROWS_A_TASK = 250_000


def _tasks(spark: SparkSession, d: str) -> int:
    """Tasks among which the calls are dealt, by the line items that make them (counted in the heads of the files)."""
    return max(spark.sparkContext.defaultParallelism, -(-_t(spark, d, "lineitem").count() // ROWS_A_TASK))


def _calls(spark: SparkSession, d: str, symbols: DataFrame) -> DataFrame:
    """What CALLS says: line items and symbols meet by name, and are made distinct where they met, as the name is one of the columns."""
    n, line = _tasks(spark, d), F.col("l_linenumber")
    number = lambda c: F.concat(F.lit("o"), c.cast("string"))
    called = F.when(line == 1, number(F.col("l_orderkey"))).when(line == 2, number(F.col("l_orderkey") % 100)).otherwise(F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    lines = _t(spark, d, "lineitem").select(number(F.col("l_orderkey")).alias("caller_name"), called.alias("callee_name")).repartition(n, "caller_name")
    own = symbols.select("path", "pkg", F.col("id").alias("caller_id"), F.col("name").alias("caller_name"), F.col("receiver").alias("caller_receiver"), F.col("start_row").alias("caller_start_row"))
    return lines.join(own.repartition(n, "caller_name"), "caller_name").select(*own.columns, "callee_name").distinct()


def _base(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    symbols = _made(spark, d, SYMBOLS).withColumns({"summary": F.concat(F.lit("Symbol: "), "name"), "doc": F.lit("")})
    inherits = _made(spark, d, INHERITS)
    return {"symbols": symbols, "call_edges": _calls(spark, d, symbols), "imports": _made(spark, d, IMPORTS), "inherits": inherits}


def _flat(e: DataFrame) -> DataFrame:
    return e.select("edge_kind", "source_id", "target_id", "target_kind", "location.*", "confidence")


def bound(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return put


_CALLEES = "SELECT DISTINCT 'CALLEES' AS edge_kind, caller_id AS source_id, s.id AS target_id, s.kind AS target_kind, c.path AS file, o.start_row AS \"start\", o.end_row AS \"end\", 0.5::DOUBLE AS confidence FROM calls c JOIN sym s ON s.name = c.callee_name JOIN sym o ON o.id = c.caller_id"
_CALLERS = "SELECT DISTINCT 'CALLERS' AS edge_kind, s.id AS source_id, o.id AS target_id, o.kind AS target_kind, o.path AS file, o.start_row AS \"start\", o.end_row AS \"end\", 0.5::DOUBLE AS confidence FROM calls c JOIN sym s ON s.name = c.callee_name AND s.path <> c.path JOIN sym o ON o.id = c.caller_id AND o.kind IN ('FUNCTION', 'METHOD')"


@bound(f"WITH {_S}, {_C} {_CALLEES}")
def graph_callees(spark: SparkSession, d: str) -> DataFrame:
    b = _base(spark, d)
    return _flat(edges.callees(b["symbols"], b["call_edges"], _tasks(spark, d)))


@bound(f"WITH {_S}, {_C} {_CALLERS}")
def graph_callers(spark: SparkSession, d: str) -> DataFrame:
    b = _base(spark, d)
    return _flat(edges.callers(b["symbols"], b["call_edges"], tasks=_tasks(spark, d)))


@bound(f"""WITH {_S}, {_C}, v AS (SELECT DISTINCT caller_id, callee_name FROM calls)
SELECT 'TESTS' AS edge_kind, s.id AS source_id, t.id AS target_id, t.kind AS target_kind, t.path AS file, t.start_row AS "start", t.end_row AS "end", 0.7::DOUBLE AS confidence
FROM sym t JOIN v ON t.id = caller_id JOIN sym s ON s.name = callee_name WHERE ends_with(t.path, '_test.go')""")
def graph_tests_of_calls(spark: SparkSession, d: str) -> DataFrame:
    b = _base(spark, d)
    return _flat(edges.tests(b["symbols"], b["call_edges"], semantics=Semantics(tests_per_symbol=False)))


@bound(f"""WITH {_S} SELECT 'TESTS' AS edge_kind, s.id AS source_id, t.id AS target_id, t.kind AS target_kind, t.path AS file, t.start_row AS "start", t.end_row AS "end", 0.7::DOUBLE AS confidence
FROM sym t, sym s WHERE ends_with(t.path, '_test.go') AND s.name IN ('p0', 'o7')""")
def graph_tests_of_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Every test symbol for each of two symbols that are asked for."""
    s = _base(spark, d)["symbols"]
    return _flat(edges.tests(s, only=s.where("name IN ('p0', 'o7')").select("id")))


@bound(f"""WITH {_S}, {_I} SELECT 'IMPORTS' AS edge_kind, s.id AS source_id, 'pkg:' || import_path AS target_id, 'PACKAGE' AS target_kind, i.path AS file, i.start_row AS "start", i.end_row AS "end", 0.4::DOUBLE AS confidence
FROM sym s JOIN imp i USING (path)""")
def graph_imports(spark: SparkSession, d: str) -> DataFrame:
    b = _base(spark, d)
    return _flat(edges.imports(b["symbols"], b["imports"]))


@bound(f"""WITH m AS ({METHODS.format(**_DUCK)}), h AS ({INHERITS.format(**_DUCK)})
SELECT 'OVERRIDES' AS edge_kind, m.id AS source_id, p.id AS target_id, 'METHOD' AS target_kind, p.path AS file, p.start_row AS "start", p.end_row AS "end", 0.4::DOUBLE AS confidence
FROM m JOIN h ON h.path = m.path AND h.class_name = m.receiver JOIN m p ON p.path = m.path AND p.receiver = h.parent_name AND p.name = m.name""")
def graph_overrides(spark: SparkSession, d: str) -> DataFrame:
    return _flat(edges.overrides(_made(spark, d, METHODS), _made(spark, d, INHERITS)))


_OF_O7 = f"""{_S}, {_C}, e AS ({_CALLEES} UNION ALL {_CALLERS}
 UNION ALL SELECT 'TESTS', s.id, t.id, t.kind, t.path, t.start_row, t.end_row, 0.7 FROM sym t, sym s WHERE ends_with(t.path, '_test.go') AND s.name = 'o7'),
r AS (SELECT *, row_number() OVER (PARTITION BY edge_kind ORDER BY target_id) AS k FROM e WHERE source_id = (SELECT id FROM sym WHERE name = 'o7'))"""


@bound(f"WITH {_OF_O7} SELECT {_FLAT} FROM r WHERE k <= 50")
def graph_references(spark: SparkSession, d: str) -> DataFrame:
    return _flat(edges.references(_base(spark, d), "o7", limit=50)[0])


@bound(f"WITH {_OF_O7} SELECT edge_kind, least(count(*), 200) AS total_count, count(*) > 50 AS truncated FROM r GROUP BY edge_kind")
def graph_reference_counts(spark: SparkSession, d: str) -> DataFrame:
    return edges.references(_base(spark, d), "o7", limit=50)[1]


@bound(f"""WITH {_S}, w AS (SELECT id, path, start_row, end_row FROM sym
 UNION ALL SELECT 'fn:other.' || name, CASE WHEN id_kind = 'fn' THEN path END, CASE WHEN id_kind = 'fn' THEN start_row END, CASE WHEN id_kind = 'fn' THEN end_row END FROM sym WHERE starts_with(name, 'o')
 UNION ALL SELECT 'meth:c0.k1.' || name, NULL, NULL, NULL FROM sym WHERE starts_with(name, 'o') UNION ALL SELECT 'pkg:' || pkg, NULL, NULL, NULL FROM sym GROUP BY pkg
 UNION ALL SELECT 'file:' || path, path, 0, 9 FROM sym GROUP BY path)
SELECT id, path, start_row, end_row, path IS NOT NULL AS found FROM w""")
def graph_locate(spark: SparkSession, d: str) -> DataFrame:
    s = _base(spark, d)["symbols"]
    files = s.select(F.col("path").alias("rel_path"), "path").distinct().withColumn("line_count", F.lit(9))
    o = s.where("name LIKE 'o%'")
    ids = s.select("id").unionAll(o.select(F.concat(F.lit("fn:other."), "name"))).unionAll(o.select(F.concat(F.lit("meth:c0.k1."), "name"))).unionAll(s.select(F.concat(F.lit("pkg:"), "pkg"))).unionAll(files.select(F.concat(F.lit("file:"), "path")))
    return edges.locate(s, files, ids)


@bound(f"""WITH {_S}, {_C}, e AS ({_CALLERS}), w AS (SELECT id, CASE name WHEN 'o7' THEN 'p0' ELSE 'fresh' END AS new_name FROM sym WHERE name IN ('o7', 'o8', 'p3')),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY target_id) AS k FROM e), t AS (SELECT id FROM sym WHERE ends_with(path, '_test.go') ORDER BY id LIMIT 100)
SELECT w.id, new_name, coalesce((SELECT string_agg(target_id, ' ' ORDER BY target_id) FROM r WHERE source_id = w.id AND k <= 100), '') AS callers, (SELECT string_agg(id, ' ' ORDER BY id) FROM t) AS tests,
 coalesce((SELECT string_agg(id, ' ' ORDER BY id) FROM sym WHERE name = new_name), '') AS conflicts, new_name = 'fresh' AS safe_to_rename FROM w""")
def graph_edit_impact(spark: SparkSession, d: str) -> DataFrame:
    b = _base(spark, d)
    renames = b["symbols"].where("name IN ('o7', 'o8', 'p3')").select("id", F.when(F.col("name") == "o7", "p0").otherwise("fresh").alias("new_name"))
    return edges.edit_impact(b, renames).withColumns({c: F.array_join(c, " ") for c in ("callers", "tests", "conflicts")})


@bound(f"WITH {_S} SELECT m.id, m.path, m.seq, c.id AS receiver_id FROM sym m LEFT JOIN sym c ON c.name = m.receiver AND c.kind = 'CLASS' WHERE m.receiver <> ''")
def graph_receivers(spark: SparkSession, d: str) -> DataFrame:
    return resolve_receivers(_base(spark, d)["symbols"])


@bound(f"WITH {_S}, {_C} SELECT id FROM sym WHERE id NOT IN (SELECT caller_id FROM calls) AND NOT (lang = 'go' AND regexp_matches(name, '^[A-Z]'))")
def graph_dead_symbols(spark: SparkSession, d: str) -> DataFrame:
    b = _base(spark, d)
    return architecture.dead_symbols(b["symbols"], b["call_edges"], None).select("id")


@bound(f"WITH {_S} SELECT id, path, seq FROM sym WHERE regexp_matches(name, '^p1[^/]*$') AND pkg = 'Brand#2' ORDER BY path, seq LIMIT 20")
def graph_find_symbol(spark: SparkSession, d: str) -> DataFrame:
    return names.find_symbol(_base(spark, d)["symbols"], "Brand#2.p1*").select("id", "path", "seq")


@bound("""WITH f AS (SELECT n_nationkey, 'root.' || lower(n_name) AS pkg, 'f' || n_nationkey AS path FROM nation),
i AS (SELECT c_custkey, c_nationkey, CASE c_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS r FROM customer)
SELECT DISTINCT 'f' || c_nationkey AS src, CASE r WHEN 2 THEN 'f' || c_nationkey ELSE 'f' || ((c_nationkey * 7 + 3) % 25) END AS dst FROM i WHERE r IS NOT NULL""")
def graph_import_files(spark: SparkSession, d: str) -> DataFrame:
    """Whole names, endings of names and relative paths; one import in four leads nowhere."""
    n = _t(spark, d, "nation")
    files = n.select(F.concat(F.lit("root."), F.lower("n_name")).alias("pkg"), F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("path"))
    names_ = n.select(F.col("n_nationkey").alias("to"), F.lower("n_name").alias("to_name"))
    c = _t(spark, d, "customer").withColumn("to", (F.col("c_nationkey") * 7 + 3) % 25).join(names_, "to")
    way = F.col("c_custkey") % 4
    target = F.when(way == 0, F.concat(F.lit("root."), "to_name")).when(way == 1, F.col("to_name")).when(way == 2, F.lit("./x")).otherwise(F.lit("no.where"))
    return architecture.resolve_imports(c.select(F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("path"), target.alias("import_path")), files)


# --- diffs: each customer's line items are one diff, each order a file in it

_DIFF = """SELECT o_custkey AS diff, o_orderkey * 10 AS n, '+++ b/o' || o_orderkey AS line FROM {orders}
UNION ALL SELECT DISTINCT o_custkey, o_orderkey * 10 + l_linenumber, '@@ -' || l_linenumber || ',' || (l_suppkey % 4) || ' +' || (l_partkey % 90) || CASE WHEN l_partkey % 3 = 0 THEN '' ELSE ',' || (l_partkey % 6) END || ' @@ f()' FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey"""
_HUNKS = "h AS (SELECT DISTINCT o_custkey AS diff, 'o' || o_orderkey AS file, o_orderkey * 10 + l_linenumber AS place, l_partkey % 90 AS p, l_suppkey % 4 AS old, CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE l_partkey % 6 END AS new FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    return _made(spark, d, _DIFF)


@bound(f"WITH {_HUNKS} SELECT diff, file, (greatest(p, 1) - 1)::INTEGER AS \"start\", (greatest(p, 1) - 1 + new)::INTEGER AS \"end\", place FROM h WHERE new > 0")
def diff_hunks(spark: SparkSession, d: str) -> DataFrame:
    return changes.parse_diff(_diffs(spark, d), diff="diff")[0]


@bound(f"WITH {_HUNKS} SELECT o_custkey AS diff, 'o' || o_orderkey AS file, o_orderkey * 10 AS place, coalesce(sum(new), 0)::BIGINT AS added, coalesce(sum(old), 0)::BIGINT AS deleted, count(*) FILTER (new > 0) AS hunks FROM orders LEFT JOIN h ON file = 'o' || o_orderkey GROUP BY ALL")
def diff_summary(spark: SparkSession, d: str) -> DataFrame:
    return changes.parse_diff(_diffs(spark, d), diff="diff")[1]


# --- chunks and layers: documents are files, each four lines of them a symbol

_DOCS = """l0 AS (SELECT doc_id, source, lang, string_split(text, chr(10)) AS p FROM documents WHERE text <> ''),
l1 AS (SELECT doc_id, source, lang, CASE WHEN p[len(p)] = '' THEN p[:len(p) - 1] ELSE p END AS p FROM l0),
b AS (SELECT doc_id, source, lang, p, unnest(range(0, (len(p) + 3) // 4)) AS k FROM l1),
s AS (SELECT doc_id, source AS pkg, 'd' || doc_id AS path, lang, k, 'b' || k || '_' || (doc_id // 3) AS name, 'fn:' || source || '.b' || k || '_' || (doc_id // 3) AS id, array_to_string(p[k * 4 + 1 : k * 4 + 4], chr(10)) AS text, trim(p[k * 4 + 1], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS sig,
 k * 4 AS a, least(k * 4 + 4, len(p)) AS z FROM b),
c AS (SELECT id AS caller, pkg, path, a, 'b' || ((k * 7 + 1) % 5) || '_' || (doc_id // 3) AS callee FROM s)"""


def _documents(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    docs = _t(spark, d, "documents").where("text <> ''").withColumns({"path": F.concat(F.lit("d"), F.col("doc_id").cast("string")), "pkg": F.col("source")})
    files = docs.select("path", F.col("path").alias("rel_path"), "pkg", "lang", "text")
    rows = pattern.lines_of(docs, ["path"], "text").groupBy("path").agg(F.count("*").cast("int").alias("line_count"))
    files = files.join(rows, "path")
    group = F.concat(F.lit("_"), F.floor(F.substring("path", 2, 20).cast("long") / 3).cast("string"))
    blocks = files.select("path", "pkg", "lang", "line_count", F.explode(F.expr("sequence(0, (line_count + 3) div 4 - 1)")).alias("k")).where("line_count > 0")
    name = lambda k: F.concat(F.lit("b"), k.cast("string"), group)
    s = blocks.select("path", "pkg", "lang", F.col("k").cast("int").alias("seq"), F.lit("function_declaration").alias("grammar_kind"), F.lit("FUNCTION").alias("kind"), name(F.col("k")).alias("name"), F.lit("").alias("receiver"), (F.col("k") * 4).cast("int").alias("start_row"), F.least(F.col("k") * 4 + 4, F.col("line_count")).cast("int").alias("end_row"), F.lit("").alias("doc"))
    s = s.withColumns({"id": F.concat(F.lit("fn:"), "pkg", F.lit("."), "name"), "summary": F.concat(F.lit("Function: "), "name")})
    calls = s.select("path", "pkg", F.col("id").alias("caller_id"), F.col("start_row").alias("caller_start_row"), name((F.col("seq") * 7 + 1) % 5).alias("callee_name"))
    return {"files": files, "symbols": s, "call_edges": calls}


@bound(f"""WITH {_DOCS}, u AS (SELECT callee, string_agg(DISTINCT caller, ' ' ORDER BY caller) AS callers FROM c GROUP BY callee),
v AS (SELECT c.caller, c.path, c.a, s.id AS target, row_number() OVER (PARTITION BY c.path, c.caller, c.a, c.callee ORDER BY CASE WHEN s.path = c.path THEN 0 WHEN s.pkg = c.pkg THEN 1 ELSE 2 END, s.path, s.k) AS r, c.pkg, c.callee FROM c LEFT JOIN s ON s.name = c.callee)
SELECT s.id, s.path AS file, s.a + 1 AS start_line, s.z AS end_line, md5(s.text) AS text, md5(s.sig) AS signature, coalesce(callers, '') AS callers, coalesce(v.target, 'fn:' || v.pkg || '.' || v.callee) AS callees
FROM s LEFT JOIN u ON u.callee = s.name LEFT JOIN v ON v.caller = s.id AND v.path = s.path AND v.a = s.a AND r = 1""")
def chunk_functions(spark: SparkSession, d: str) -> DataFrame:
    c = chunks.chunks(_documents(spark, d), ("function",))
    return c.select("id", "file", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5("text").alias("text"), F.md5("signature").alias("signature"), F.array_join("callers", " ").alias("callers"), F.array_join("callees", " ").alias("callees"))


@bound(f"WITH {_DOCS} SELECT id, path, a::INTEGER AS \"start\", z::INTEGER AS \"end\", md5(text) AS digest FROM s")
def layer_source(spark: SparkSession, d: str) -> DataFrame:
    b = _documents(spark, d)
    return tree.node_source(b, b["symbols"].select("id")).select("id", "path", "start", "end", F.md5("text").alias("digest"))


@bound(f"WITH {_DOCS} SELECT id, path, k::INTEGER AS seq, md5('Function: ' || sig) AS summary, md5(text) AS signature FROM s")
def layer_signature(spark: SparkSession, d: str) -> DataFrame:
    b = _documents(spark, d)
    return tree.nodes(b, b["symbols"].select("id"), ("summary", "signature")).select("id", "path", "seq", F.md5("summary").alias("summary"), F.md5("signature").alias("signature"))


# --- retrieval

@bound(r"""
WITH n AS (SELECT DISTINCT p_name FROM part), t AS (SELECT p_name, unnest(regexp_extract_all(lower(p_name), '[\p{L}\p{Nd}_]+')) AS w FROM n),
h AS (SELECT p_name, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_prepend(i::HUGEINT, list_transform(string_split(w, ''), lambda c: ord(c)::HUGEINT))), lambda a, x: (xor(a, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM t, (VALUES (0), (1), (2), (3)) v(i)),
c AS (SELECT p_name, (h % 64)::INTEGER AS cell, sum(CASE WHEN (h // 4294967296::HUGEINT) % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS v FROM h GROUP BY ALL)
SELECT p_name, cell, round(v / sqrt(sum(v * v) OVER (PARTITION BY p_name)), 9) AS value FROM c QUALIFY v <> 0""")
def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the embeddings of all part names."""
    from ..shipping import ship_package

    ship_package(spark)
    v = _t(spark, d, "part").select("p_name").distinct().select("p_name", F.posexplode(hash_embedding(tokens(F.col("p_name")), 64)).alias("cell", "value"))
    return v.where("value <> 0").withColumn("value", F.round("value", 9))


@bound(f"WITH {_BM25} SELECT doc_id::VARCHAR AS seed, round(s, 6) AS weight FROM bm WHERE s > 0 ORDER BY round(s, 9) DESC, doc_id LIMIT 3")
def expanded_seeds(spark: SparkSession, d: str) -> DataFrame:
    """The best hits of a query as weighted seeds of a traversal."""
    from ..operators.traverse import normalise_seeds

    ids, weights = retrieve.expand_seeds(retrieve.bm25(_t(spark, d, "documents"), "doc_id", "text", QUERY_TEXT, 10))
    seeds = normalise_seeds(seeds=[str(i) for i in ids], weights=weights)
    return spark.createDataFrame([(s.id, s.weight) for s in seeds], "seed string, weight double").withColumn("weight", F.round("weight", 6))
