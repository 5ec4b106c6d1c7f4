"""Queries over source code: the files that ``source_tree`` derives from the documents, and a few built-in ones that queries ask for by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import architecture, ast_query, changes, chunks, edges, envelope, names, pattern, retrieve, traverse, tree, trees
from ..sources.extract import base_relations, resolve_receivers, token_rows
from ..sources.scan import files_relation
from .source_tree import ROOT, derived_files

SOURCES = {
    "go.mod": "module example.com/demo\n",
    "shop/cart.go": 'package shop\n\nimport (\n\t"fmt"\n\t"example.com/demo/pay"\n)\n\n// Cart holds items.\n// It is not safe for sharing.\ntype Cart struct {\n\titems []string\n}\n\n// Add puts an item in.\nfunc (c *Cart) Add(item string) {\n\tif item == "" {\n\t\treturn\n\t}\n\tc.items = append(c.items, item)\n}\n\nfunc (c *Cart) Checkout() error {\n\tfmt.Println("paying")\n\treturn pay.Charge(len(c.items))\n}\n\nfunc helper() int {\n\treturn 1\n}\n',
    "shop/cart_test.go": 'package shop\n\nfunc TestAdd(t int) {\n\tc := &Cart{}\n\tc.Add("x")\n}\n',
    "pay/pay.go": 'package pay\n\nimport "example.com/demo/shop"\n\n// Charge takes money.\nfunc Charge(n int) error {\n\treturn validate(n)\n}\n\nfunc validate(n int) error {\n\treturn nil\n}\n\nfunc Refund(n int) error {\n\treturn validate(-n)\n}\n',
    "web/user.ts": 'import { log } from "./log";\n\nexport class Base {\n  save() { log("base"); }\n}\n\nexport class User extends Base {\n  save() { record(); }\n}\n\nexport function record() { return 1; }\n',
    "tools/run.py": 'import os\n\nclass Runner:\n    def go(self):\n        return os.getcwd()\n\ndef main():\n    Runner().go()\n',
    "node_modules/x.js": "function hidden() {}\n",
    "notes.txt": "not code\n",
}
DIFF = """diff --git a/pay/pay.go b/pay/pay.go
--- a/pay/pay.go
+++ b/pay/pay.go
@@ -6 +6,2 @@ func Charge(n int) error {
@@ -12,2 +13 @@
diff --git a/README.md b/README.md
--- a/README.md
+++ b/README.md
@@ -1,3 +0,0 @@
@@ -9 +6 @@
"""


def raw_files(spark: SparkSession, sources: dict[str, str] | None = None, root: str = ROOT) -> DataFrame:
    rows = [(f"{root}/{p}", t.encode(), len(t.encode()), 0) for p, t in (sources or SOURCES).items()]
    return spark.createDataFrame(rows, "path string, content binary, length long, mtime_ns long")


def all_files(spark: SparkSession, d: str | None) -> DataFrame:
    """Raw files: the built-in ones, and those derived from the tables in ``d``."""
    return raw_files(spark) if d is None else raw_files(spark).unionByName(derived_files(spark, d))


_bases: dict[tuple[str, str | None], dict[str, DataFrame]] = {}


def demo(spark: SparkSession, d: str | None = None) -> dict[str, DataFrame]:
    """The base relations of the tree, kept for one tree at a time."""
    key = spark.sparkContext.applicationId, d
    if key not in _bases:
        _bases.clear()
        _bases[key] = base_relations(files_relation(all_files(spark, d), ROOT, max_files=None)[0], cache=False)
    return _bases[key]


def once(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The base relations of the tree over records that are extracted and stored now, for queries that read them more than once."""
    return base_relations(files_relation(all_files(spark, d), ROOT, max_files=None)[0], store=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _q(f: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[f"code_{f.__name__.strip('_')}"] = f


def _calls(b: dict[str, DataFrame]) -> DataFrame:
    return b["call_edges"].select(F.col("caller_id").alias("src"), F.col("callee_name").alias("dst"))


def _flat(e: DataFrame) -> DataFrame:
    return e.select("edge_kind", "source_id", "target_id", "target_kind", "location.*", "confidence")


@_q
def _files(s, d):
    return files_relation(all_files(s, d), ROOT, max_files=None)[0].drop("content")


@_q
def _load_errors(s, d):
    return files_relation(all_files(s, d), ROOT, max_files=3, max_bytes=400)[1]


@_q
def _symbols(s, d):
    return demo(s, d)["symbols"]


@_q
def _call_edges(s, d):
    return demo(s, d)["call_edges"]


@_q
def _call_sites(s, d):
    return demo(s, d)["call_sites"]


@_q
def _tokens(s, d):
    return token_rows(demo(s, d)["files"])


@_q
def _find_symbol_bodies(s, d):
    return envelope.find_symbol(demo(s, d)["symbols"], "shop.*", demo(s, d)["files"], include_body=True).rows.select("id", "body")


@_q
def _suggestions(s, d):
    return envelope.find_symbol(demo(s, d)["symbols"], "pay.Charg").suggestions


@_q
def _imports(s, d):
    return demo(s, d)["imports"]


@_q
def _inherits(s, d):
    return demo(s, d)["inherits"]


@_q
def _receivers(s, d):
    return resolve_receivers(once(s, d)["symbols"])


@_q
def _callees(s, d):
    b = once(s, d)
    return _flat(edges.callees(b["symbols"], b["call_edges"]))


@_q
def _callers(s, d):
    b = once(s, d)
    return _flat(edges.callers(b["symbols"], b["call_edges"]))


@_q
def _tests(s, d):
    return _flat(edges.tests(once(s, d)["symbols"], only=s.createDataFrame([("fn:pay.Charge",)], "id string")))


@_q
def _import_edges(s, d):
    b = once(s, d)
    return _flat(edges.imports(b["symbols"], b["imports"]))


@_q
def _overrides(s, d):
    b = once(s, d)
    return _flat(edges.overrides(b["symbols"], b["inherits"]))


@_q
def _node_edges(s, d):
    return _flat(edges.node_edges(once(s, d), "fn:pay.Charge")[0])


@_q
def _references(s, d):
    return edges.references(once(s, d), "Char*")[1]


@_q
def _locate(s, d):
    b = once(s, d)
    ids = s.createDataFrame([("fn:pay.Charge",), ("meth:shop.Cart.Add",), ("file:pay/pay.go",), ("pkg:pay",), ("class:Cart",)], "id string")
    return edges.locate(b["symbols"], b["files"], ids)


@_q
def _edit_impact(s, d):
    return edges.edit_impact(once(s, d), s.createDataFrame([("fn:pay.Charge", "Refund"), ("fn:pay.Charge", "Fresh")], "id string, new_name string"))


@_q
def _graph_schema(s, d):
    return edges.graph_schema(s)


@_q
def _traverse(s, d):
    b = once(s, d)
    ends = lambda e: e.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    rel = {
        "CALLEES": lambda nodes: ends(edges.callees(b["symbols"], b["call_edges"], only=nodes)),
        "CALLERS": lambda nodes: ends(edges.callers(b["symbols"], b["call_edges"], only=nodes)),
    }
    return traverse.traverse(rel, traverse.normalise_seeds(start="meth:shop.Cart.Checkout"), ["CALLEES", "CALLERS"], 2).rows


@_q
def _find_code(s, d):
    return pattern.find_code(demo(s, d)["lines"], demo(s, d)["symbols"], "return", include_context=True)


@_q
def _search_code(s, d):
    return pattern.search_code(demo(s, d)["lines"], demo(s, d)["symbols"], demo(s, d)["call_edges"], r"return|append")


@_q
def _ast_query(s, d):
    b = once(s, d)
    return ast_query.query(b["symbols"], b["call_sites"], '((call_expression function: (identifier) @f) (#match? @f "^[vC]"))'[1:-1])


@_q
def _find_symbol(s, d):
    return names.find_symbol(demo(s, d)["symbols"], "shop.*")


@_q
def _resolve(s, d):
    return names.resolve(demo(s, d)["symbols"], "pay.Charge")  # which reads them once, and stores what fits


@_q
def _search(s, d):
    return names.search(demo(s, d)["symbols"], "charge money").select("id", "score")


@_q
def _chunks(s, d):
    return chunks.chunks(once(s, d), ("function", "class", "module"))


@_q
def _baseline_windows(s, d):
    return chunks.baseline(demo(s, d)["files"], 100, 80)


@_q
def _hybrid(s, d):
    b = once(s, d)
    c = chunks.chunks(b)
    return retrieve.hybrid(c, b["symbols"], "charge money for a cart").select("id", "score", "channel", "chunk.file")


@_q
def _overview(s, d):
    return tree.overview(demo(s, d), ROOT)


@_q
def _nodes(s, d):
    return tree.nodes(demo(s, d), s.createDataFrame([("meth:shop.Cart.Add",)], "id string"), tree.LAYERS)


@_q
def _node_source(s, d):
    return tree.node_source(demo(s, d), s.createDataFrame([("fn:pay.Charge",)], "id string"), trivia=True)


@_q
def _symbols_overview(s, d):
    return tree.symbols_overview(demo(s, d)["symbols"], f"{ROOT}/pay/pay.go")


@_q
def _hotspots(s, d):
    b = once(s, d)
    return architecture.hotspots(b["symbols"].dropDuplicates(["id"]), _calls(b)).select("id", "degree")


@_q
def _dead_code(s, d):
    b = once(s, d)
    return architecture.dead_symbols(b["symbols"], b["call_edges"]).select("id")


@_q
def _import_graph(s, d):
    b = once(s, d)
    return architecture.resolve_imports(b["imports"], b["files"])


@_q
def _cycles(s, d):
    b = once(s, d)
    i = b["imports"].withColumn("import_path", F.element_at(F.split("import_path", "/"), -1))
    return architecture.cycles(architecture.resolve_imports(i, b["files"]))


def diff_lines(spark: SparkSession, text: str = DIFF) -> DataFrame:
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "n int, line string")


@_q
def _diff_hunks(s, d):
    return changes.parse_diff(diff_lines(s))[0]


@_q
def _diff_summary(s, d):
    return changes.parse_diff(diff_lines(s))[1]


@_q
def _detect_changes(s, d):
    return changes.detect_changes(diff_lines(s), once(s, d))


# --- what the derived files hold follows from the documents in SQL: (language number, ending, class kind, rows of class, method and function)

SQL: dict[str, str] = {}
_DERIVED = """d AS (SELECT DISTINCT doc_id AS h, coalesce(source, 'none') AS s, doc_id % 6 AS m FROM documents WHERE doc_id >= 0),
l AS (SELECT * FROM (VALUES (0, 'go', 'type_declaration', 4, 7, 8, 11, 12, 15), (1, 'ts', 'class_declaration', 2, 7, 3, 6, 8, 11), (2, 'js', 'class_declaration', 2, 7, 3, 6, 8, 11),
  (3, 'rs', 'struct_declaration', 2, 5, 7, 10, 12, 15), (4, 'py', 'class_declaration', 2, 5, 3, 5, 6, 8), (5, 'php', 'class_declaration', 3, 8, 4, 7, 9, 12)) v(m, ending, kind, c1, c2, m1, m2, f1, f2)),
f AS (SELECT *, '/demo/' || s || '/d' || h || '.' || ending AS path, CASE WHEN m = 0 THEN 'Size' ELSE 'size' END AS method, CASE WHEN m = 0 THEN 'Open' ELSE 'open' END AS open FROM d JOIN l USING (m))"""


def _derived(sql: str) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {_DERIVED} {sql}"
        return f

    return put


def derived(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The base relations of the derived files alone, over stored records."""
    return base_relations(files_relation(derived_files(spark, d), ROOT, max_files=None)[0], store=True)


@_derived("""SELECT path, kind AS grammar_kind, 'Doc' || h AS name, '' AS receiver, c1 AS start_row, c2 AS end_row FROM f
UNION ALL SELECT path, 'method_declaration', method, 'Doc' || h, m1, m2 FROM f UNION ALL SELECT path, 'function_declaration', open || h, '', f1, f2 FROM f""")
def source_symbols(spark: SparkSession, d: str) -> DataFrame:
    return derived(spark, d)["symbols"].select("path", "grammar_kind", "name", "receiver", "start_row", "end_row")


@_derived("""SELECT path, method AS caller_name, 'Doc' || h AS caller_receiver, CASE WHEN m = 0 THEN 'Count' ELSE 'count' END AS callee_name, m1 + 1 AS row FROM f WHERE m < 4
UNION ALL SELECT path, open || h, '', open || (h + 6), f1 + 1 FROM f WHERE m < 4""")
def source_calls(spark: SparkSession, d: str) -> DataFrame:
    """Call sites; calls are extracted for Go, TypeScript, JavaScript and Rust."""
    return derived(spark, d)["call_sites"].select("path", "caller_name", "caller_receiver", "callee_name", "row")


@_derived("""SELECT path, CASE WHEN m = 0 THEN 'example.com/demo/src' ELSE '../src' END || h % 20 AS import_path, '' AS class_name, '' AS parent_name FROM f WHERE m < 3
UNION ALL SELECT path, '', 'Doc' || h, 'Base' || h % 7 FROM f WHERE m IN (1, 2)""")
def source_imports_and_parents(spark: SparkSession, d: str) -> DataFrame:
    b = derived(spark, d)
    i = b["imports"].select("path", "import_path", F.lit("").alias("class_name"), F.lit("").alias("parent_name"))
    return i.unionAll(b["inherits"].select("path", F.lit("").alias("import_path"), "class_name", "parent_name"))


@_derived("""SELECT path, 'method' AS capture, method AS text, m1 AS start FROM f WHERE m IN (1, 2) UNION ALL SELECT path, 'call', 'count', m1 + 1 FROM f WHERE m IN (1, 2)""")
def source_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Methods within classes that call ``count``, and these calls."""
    b = derived(spark, d)
    got = trees.match(trees.code_nodes(b["symbols"], b["call_sites"]), '(class_declaration (method_declaration ..(call_expression) @call (#eq? @call "count")) @method)')
    return got.select("path", "capture", "text", "start")


@_derived("""SELECT y.path AS path, y.open || y.h AS target, x.open || x.h AS source FROM f x JOIN f y ON y.h = x.h + 6 WHERE x.m < 4""")
def source_callers(spark: SparkSession, d: str) -> DataFrame:
    """Who calls each function from another file."""
    b = derived(spark, d)
    got = edges.callers(b["symbols"], b["call_edges"])
    name = lambda c: F.element_at(F.split(c, "[.]"), -1)
    where = b["symbols"].select(F.col("id").alias("source_id"), "path")
    return got.join(where, "source_id").select("path", name("source_id").alias("target"), name("target_id").alias("source"))
