import json

import pytest
from pyspark.sql import functions as F
from sievework.operators import architecture, ast_query, changes, chunks, edges, envelope, names, traverse, tree
from sievework.plans.code_queries import DIFF, QUERIES, ROOT, demo, diff_lines, raw_files
from sievework.plans.projects import NamedOperations, Workspace, default_operations
from sievework.semantics import Semantics
from sievework.sources import lexers
from sievework.sources.extract import base_relations, replace_file, token_rows
from sievework.sources.registry import Audit, Snapshots, extract_paths, parse_ref
from sievework.sources.scan import files_relation, scan


@pytest.fixture(scope="module")
def base(spark):
    return demo(spark)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_code_query_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def _symbols(text, lang):
    return [(r["grammar_kind"], r["name"], r["receiver"], r["start_row"], r["end_row"]) for r in lexers.extract(text, lang) if r["rec"] == "symbol"]


def test_go():
    src = 'package p\n\nimport "fmt"\n\ntype (\n\tA struct{}\n\tB int\n)\n\nfunc (r *pkg.T) M() { go f() }\n\nfunc G[T any](x T) {\n\tif x := h("}"); x {\n\t\ta.b.C(func() { d() })\n\t}\n}\nfunc (r *List[T]) N() {}\n'
    assert _symbols(src, "go") == [("type_declaration", "A", "", 4, 8), ("method_declaration", "M", "T", 9, 10), ("function_declaration", "G", "", 11, 16), ("method_declaration", "N", "", 16, 17)]
    calls = [(r["name"], r["callee_name"]) for r in lexers.extract(src, "go") if r["rec"] == "call"]
    assert calls == [("M", "f"), ("G", "h"), ("G", "C"), ("G", "d")]
    assert [(r["import_path"], r["start_row"], r["end_row"]) for r in lexers.extract(src, "go") if r["rec"] == "import"] == [("fmt", 2, 3)]


def test_typescript_and_javascript():
    src = "import {a} from './x';\nexport abstract class A<T> extends B<T> implements C {\n  constructor() { super(); }\n  private async go<T>(x: {a: string}): Promise<void> {\n    run('}'); this.y();\n  }\n}\nexport interface I { f(): void }\ntype T1 = string;\nenum E { A }\nconst f = () => 1;\nfunction* gen() { yield g(); }\n"
    assert _symbols(src, "typescript") == [("class_declaration", "A", "", 1, 7), ("method_declaration", "constructor", "A", 2, 3), ("method_declaration", "go", "A", 3, 6), ("class_declaration", "I", "", 7, 8), ("class_declaration", "T1", "", 8, 9), ("class_declaration", "E", "", 9, 10), ("function_declaration", "gen", "", 11, 12)]
    recs = lexers.extract(src, "typescript")
    assert [(r["name"], r["callee_name"]) for r in recs if r["rec"] == "call"] == [("go", "run"), ("gen", "g")]
    assert [r["parent_name"] for r in recs if r["rec"] == "inherits"] == ["B", "C"]
    assert [r["import_path"] for r in recs if r["rec"] == "import"] == ["./x"]
    assert [s[1] for s in _symbols("interface X {}\nfunction k() {}\n", "javascript")] == ["k"]


def test_python_rust_php():
    py = "@dec\nasync def f():\n    def inner(): pass\n\nclass A:\n    x = 1\n    @p\n    def m(self):\n        g()\n    class N:\n        def no(self): pass\n"
    assert _symbols(py, "python") == [("function_declaration", "f", "", 1, 3), ("class_declaration", "A", "", 4, 11), ("method_declaration", "m", "A", 7, 9)]
    assert not [r for r in lexers.extract(py, "python") if r["rec"] == "call"] and lexers.extract("def (", "python") == []
    rs = "mod m { fn hidden() {} }\npub struct S;\nimpl<T> Show for S<T> {\n    fn show(&self) { help(); self.x(); }\n}\ntrait Tr { fn a(&self); fn b(&self) { c() } }\nenum E { A }\ntype Al = u8;\npub(crate) async fn top() { '{'; }\n"
    assert [s[:3] for s in _symbols(rs, "rust")] == [("struct_declaration", "S", ""), ("method_declaration", "show", "S<T>"), ("trait_declaration", "Tr", ""), ("method_declaration", "b", "Tr"), ("enum_declaration", "E", ""), ("type_alias_declaration", "Al", ""), ("function_declaration", "top", "")]
    php = "<?php\n# no function x() {}\nfinal class A extends B {\n  public static function m() { f('}'); }\n}\ninterface I { function q(); }\ntrait T { function r() {} }\nenum E { case X; }\nfunction top() {}\n"
    assert [s[:3] for s in _symbols(php, "php")] == [("class_declaration", "A", ""), ("method_declaration", "m", "A"), ("interface_declaration", "I", ""), ("method_declaration", "q", "I"), ("trait_declaration", "T", ""), ("method_declaration", "r", "T"), ("enum_declaration", "E", ""), ("function_declaration", "top", "")]


def test_broken_text_never_fails():
    for lang in ("go", "typescript", "javascript", "rust", "php", "python"):
        for t in ("", "{", "func (", "class", '"', "import (", "impl", "fn x(", "}}}}", "type (", "\x00"):
            assert isinstance(lexers.extract(t, lang), list)


def test_symbols_ids_docs(base):
    got = {r.id: (r.kind, r.summary, r.doc) for r in base["symbols"].collect()}
    assert got["class:shop.Cart"] == ("CLASS", "Class: Cart", "Cart holds items.\n It is not safe for sharing.")
    assert got["meth:shop.Cart.Add"][0] == "METHOD" and got["fn:shop.helper"][2] == ""


def test_edges(base, spark):
    pairs = lambda e: {(r.source_id, r.target_id) for r in e.collect()}
    assert ("meth:shop.Cart.Checkout", "fn:pay.Charge") in pairs(edges.callees(base["symbols"], base["call_edges"]))
    assert pairs(edges.callers(base["symbols"], base["call_edges"])) == {("fn:pay.Charge", "meth:shop.Cart.Checkout"), ("meth:shop.Cart.Add", "fn:shop.TestAdd")}
    sure = spark.createDataFrame([("fn:pay.Charge", "fn:tools.main", "x", 1, 2)], "source_id string, target_id string, file string, start int, end int")
    got = edges.callers(base["symbols"], base["call_edges"], sure).collect()
    assert {(r.source_id, r.target_id, r.confidence) for r in got} == {("fn:pay.Charge", "fn:tools.main", 1.0), ("meth:shop.Cart.Add", "fn:shop.TestAdd", 0.5)}
    one = spark.createDataFrame([("meth:shop.Cart.Add",), ("fn:pay.Charge",)], "id string")
    assert pairs(edges.tests(base["symbols"], base["call_edges"], one, Semantics(tests_per_symbol=False))) == {("meth:shop.Cart.Add", "fn:shop.TestAdd")}
    with pytest.raises(LookupError):
        edges.references(base, "NoSuch")


def test_locate_and_impact(base, spark):
    ids = spark.createDataFrame([("fn:pay.Charge",), ("pkg:pay",), ("module:x",), ("meth:shop.Cart.Nope",)], "id string")
    assert {r.id: r.found for r in edges.locate(base["symbols"], base["files"], ids).collect()} == {"fn:pay.Charge": True, "pkg:pay": False, "module:x": False, "meth:shop.Cart.Nope": False}
    r = edges.edit_impact(base, spark.createDataFrame([("fn:pay.Charge", "helper")], "id string, new_name string")).first()
    assert r.conflicts == ["fn:shop.helper"] and not r.safe_to_rename and r.callers == ["meth:shop.Cart.Checkout"]


def test_ast_queries(base):
    q = lambda p: {(r.capture, r.text) for r in ast_query.query(base["symbols"], base["call_sites"], p).collect()}
    assert q('(method_declaration name: (_) @m receiver: (_) @r (#eq? @m "Add"))') == {("m", "Add"), ("r", "Cart")}
    assert ("c", "Cart") in q("(type_declaration) @c")
    for bad in ("(", "(a (b))", "(function_declaration)", "(function_declaration body: (_) @b)", "(f) @a (#near? @a \"x\")"):
        with pytest.raises(ValueError):
            q(bad)


def test_changes(base, spark):
    hunks, summary = changes.parse_diff(diff_lines(spark))
    assert {(r.file, r.start, r.end) for r in hunks.collect()} == {("pay/pay.go", 5, 7), ("pay/pay.go", 12, 13), ("README.md", 5, 6)}
    assert {(r.file, r.added, r.deleted, r.hunks) for r in summary.collect()} == {("pay/pay.go", 3, 3, 2), ("README.md", 1, 4, 1)}
    two = "+++ b/a\n@@ -1,2 +1,5 @@\n@@ -1,3 +0,0 @@\n"
    h, s = changes.parse_diff(diff_lines(spark, two))
    assert [(r.start, r.end) for r in h.collect()] == [(0, 5)] and [(r.added, r.deleted, r.hunks) for r in s.collect()] == [(5, 5, 1)]
    got = changes.detect_changes(diff_lines(spark, DIFF), base).orderBy("order").collect()
    assert [(r.file, r.id) for r in got] == [("pay/pay.go", None), ("README.md", None), ("pay/pay.go", "fn:pay.Charge")]
    assert got[2].callers == ["meth:shop.Cart.Checkout"]
    for bad in ({}, {"base": "a", "since": "b"}, {"base": "-x"}):
        with pytest.raises(ValueError):
            changes.check_refs(**bad)


def test_chunks(base, tmp_path):
    got = {r.id: r for r in chunks.chunks(base, ("function", "class", "module")).collect()}
    add = got["meth:shop.Cart.Add"]
    assert add.text.startswith("// Add puts") and add.start_line == 15 and add.signature.startswith("Add puts an item in.\n\nfunc (c *Cart) Add")
    cart = got["class:shop.Cart"]
    assert cart.text.endswith("Methods:\nfunc (c *Cart) Add(item string) {\nfunc (c *Cart) Checkout() error {") and "fn:pay.Charge" in cart.callees
    assert "fn:shop.TestAdd" not in got and "fn:shop.append" in got["meth:shop.Cart.Add"].callees
    assert got["module:shop.shop/cart.go"].kind == "MODULE"
    chunks.write_ndjson(chunks.chunks(base).coalesce(1), str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    assert [(x["file"], x["start_line"]) for x in lines] == sorted((x["file"], x["start_line"]) for x in lines)
    with pytest.raises(ValueError):
        chunks.chunks(base, ())


def test_chunks_cut_their_texts_out_once(base, spark):
    plan = chunks.chunks(base)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # classes with their methods; before, each policy joined files, callers and callees anew
    calls = spark.createDataFrame([("fn:b", "known"), ("fn:a", "known"), ("fn:a", "unknown")], "caller_id string, callee_name string")
    names = spark.createDataFrame([("known",), ("known",), ("other",)], "name string")
    assert [(r.name, r.callers) for r in chunks.callers_of(names, calls).collect()] == [("known", ["fn:a", "fn:b"])]


@pytest.mark.parametrize("options", [{}, {"with_tests": True}, {"include": ["*.go"], "exclude": ["pay.go"]}, {"languages": ["typescript", "python"]}, {"with_tests": True, "languages": ["go"], "include": ["shop/*"]}])
def test_byte_windows_by_walking_every_file(base, options):
    """Files in order, windows from 0 in steps, the first that reaches the end is the last, one running number, lines counted byte by byte."""
    import fnmatch

    kept, want = [], []
    for f in sorted(base["files"].collect(), key=lambda f: f.path.encode()):
        name = f.rel_path.rsplit("/", 1)[-1]
        fits = lambda globs: any(fnmatch.fnmatch(x, g) and x.count("/") == g.count("/") for g in globs for x in (f.rel_path, name))  # noqa: B023, E731
        if (not options.get("with_tests") and f.rel_path.endswith("_test.go")) or ("include" in options and not fits(options["include"])) or ("exclude" in options and fits(options["exclude"])):
            continue
        if f.lang in options.get("languages", [f.lang]):
            kept.append(f)
    for f in kept:
        raw, at = f.text.encode(), 0
        while at < len(raw):
            end = min(at + 50, len(raw))
            want.append((f"baseline:{f.rel_path}:{len(want)}", f.path, raw[:at].count(b"\n") + 1, raw[: end - 1].count(b"\n") + 1, at, end, raw[at:end].decode(errors="replace")))
            if end == len(raw):
                break
            at += 40
    got = chunks.baseline(base["files"], 50, 40, **options).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted(want) and want and {r.policy for r in got} == {"baseline"}
    with pytest.raises(ValueError):
        chunks.baseline(base["files"], 40, 50)


def test_tree_and_layers(base, spark):
    full = tree.overview(base, ROOT).collect()
    assert full[0].id == ROOT and {r.kind for r in full} == {"REPO", "PACKAGE", "FILE", "CLASS", "FUNCTION", "METHOD"}
    assert max(r.spent for r in tree.overview(base, ROOT, budget=900).collect()) <= 900
    one = spark.createDataFrame([("meth:shop.Cart.Add",)], "id string")
    r = tree.nodes(base, one, tree.LAYERS, spark.createDataFrame([("meth:shop.Cart.Add", "func (item string) error")], "id string, text string")).first()
    assert r.control == "branching" and [s.kind for s in r.statements] == ["block", "if", "return", "block", "expr", "block"]
    assert (r.types.params, r.types.result) == ("item string", "error") and r.summary == "Method: func (c *Cart) Add(item string) {"
    assert tree.node_source(base, one, 0, 16).first().text.count("\n") == 1
    with pytest.raises(ValueError):
        tree.nodes(base, one, ("nope",))


def test_search(base):
    got = [(r.id, r.score) for r in names.search(base["symbols"], "charge").collect()]
    assert got[0] == ("fn:pay.Charge", 0.9)
    assert names.search(base["symbols"], "shop", kinds=["class"]).first().score == pytest.approx(0.4)
    assert names.search(base["symbols"], [], pattern="^Ref").first().id == "fn:pay.Refund"
    assert names.resolve(base["symbols"], "pay.Charge").first().ambiguous == 1


def test_architecture(base):
    parts = architecture.report(base)
    assert {r.what: r.n for r in parts["counts"].collect()}["files"] == 5
    assert "fn:shop.helper" in {r.id for r in parts["dead_code"].collect()} and not parts["truncated"]


def test_scan_limits(spark, tmp_path):
    for p, t in {"a/x.go": "package a\n", ".git/h.go": "package h\n", "a/.d/y.go": "package y\n", "vendor/v.go": "package v\n", "b.PY": "x = 1\n", "n.txt": "no", "big.go": "x" * 100}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    files, errors = scan(spark, str(tmp_path), max_bytes=50)
    assert {(r.rel_path, r.pkg, r.lang, r.line_count) for r in files.collect()} == {("a/x.go", "a", "go", 1), ("b.PY", "", "python", 1)}
    assert [r.path for r in errors.collect()] == [str(tmp_path / "big.go")]


def test_projects_and_snapshots(spark, tmp_path):
    code = tmp_path / "code"
    code.mkdir()
    (code / "a.go").write_text("package a\n\nfunc F() { G() }\n")
    w = Workspace(spark, str(tmp_path / "work"))
    assert not w.status(str(code))["indexed"]
    assert w.index(str(code))["status"] == "indexed" and w.index(str(code))["status"] == "unchanged"
    assert w.status(str(code))["fresh"] and [r.name for r in w.projects().collect()] == ["code"]
    (code / "b.go").write_text("package a\n\nfunc G() {}\n")
    (code / "a.go").unlink()
    assert w.index(str(code), force=True)["files"] == 1
    assert [r.id for r in w.project(str(code))["symbols"].collect()] == ["fn:G"]
    assert w.delete(str(code))["deleted"] and not w.delete(str(code))["deleted"]
    with pytest.raises(ValueError):
        w.index(str(code), mode="odd")


def test_replacing_a_file(spark, base):
    new = base_relations(files_relation(raw_files(spark, {"pay/pay.go": "package pay\n\nfunc Only() {}\n"}), ROOT)[0], cache=False)
    ids = {r.id for r in replace_file(base, new)["symbols"].collect()}
    assert "fn:pay.Only" in ids and "fn:pay.Charge" not in ids and "class:shop.Cart" in ids


def test_stream_reextracts(spark, tmp_path):
    from sievework.streaming.watch import call_statistics, watch_files

    src = tmp_path / "src"
    src.mkdir()
    (src / "m.py").write_text("def one(): pass\n")
    snaps = Snapshots(spark, str(tmp_path / "snaps"))
    for text in ("def one(): pass\n", "def two(): pass\n"):
        (src / f"m{len(text)}{text[4]}.py").write_text(text)
        watch_files(spark, str(src), snaps, "p", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert {r.name for r in snaps.load("p")["symbols"].collect()} == {"one", "two"}
    log = tmp_path / "audit"
    log.mkdir()
    Audit(str(log / "a.json")).watch("t", lambda **a: 1)(path="/x")
    q = call_statistics(spark, str(log)).writeStream.outputMode("complete").format("memory").queryName("calls").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("calls").first().calls == 1


def test_call_sites_have_their_rows(base, spark):
    text = "package a\n\nfunc F() {\n\tG(); G()\n\tH()\n\tG()\n}\n"
    new = base_relations(files_relation(raw_files(spark, {"a.go": text}), ROOT)[0], cache=False)
    assert sorted((r.callee_name, r.row) for r in new["call_sites"].collect()) == [("G", 3), ("G", 3), ("G", 5), ("H", 4)]
    assert sorted(r.callee_name for r in new["call_edges"].collect()) == ["G", "H"]
    got = ast_query.query(new["symbols"], new["call_sites"], '(call_expression function: (identifier) @f (#eq? @f "G"))').collect()
    assert [(r.start_row, r.end_row, r.text) for r in got] == [(3, 4, "G"), (3, 4, "G"), (5, 6, "G")]


def test_answers_and_their_envelopes(base):
    lines, s, files = base["lines"], base["symbols"], base["files"]
    every = envelope.find_code(lines, s, "return", limit=50)
    assert not every.truncated and every.total == every.rows.count() > 2
    find = envelope.find_code(lines, s, "return", limit=2, include_context=True)
    assert find.truncated and find.total == every.total and find.rows.count() == 2 and "id" in find.rows.columns
    groups = envelope.search_code(lines, s, base["call_edges"], "return", limit=1)
    assert groups.truncated and groups.rows.count() == 1 and groups.total <= 4
    assert envelope.search(s, "charge", limit=1).total >= 1
    one = envelope.find_symbol(s, "pay.Charge", files, include_body=True)
    assert (one.total, one.truncated, one.suggestions) == (1, False, None) and one.rows.first().body.startswith("func Charge(n int) error {\n")
    none = envelope.find_symbol(s, "pay.Charg")
    assert none.total == 0 and none.suggestions.first().name == "Charge"


def test_snapshots_are_replaced_as_a_whole(spark, base, tmp_path):
    snaps = Snapshots(spark, str(tmp_path / "snaps"))
    snaps.save("p", base)
    first = snaps.load("p")["symbols"].count()
    home = snaps._home("p")
    base["files"].limit(0).write.parquet(f"{home}/v-99999999999999999999/files")  # a writer that was lost
    assert snaps.load("p")["symbols"].count() == first
    for _ in range(2):
        snaps.save("p", snaps.load("p"))
    assert len(snaps._versions(home)) == 2 and snaps.load("p")["call_sites"].count() == base["call_sites"].count()
    snaps.save("q", base)
    assert snaps.evict(1 << 40) == [] and snaps.evict(0) != [] and snaps.load("p") is None and snaps.load("q") is None


def test_registry_always_has_a_whole_version(spark, tmp_path):
    import datetime
    from pathlib import Path

    from sievework.sources.registry import Registry, versions

    home = tmp_path / "projects"
    r = Registry(spark, str(home))
    row = lambda p: {"name": p, "path": p, "indexed_at": datetime.datetime(2024, 1, 2), "files": 1, "languages": ["go"], "mode": "full"}
    assert r.list().collect() == [] and r.get("/a") is None
    for p in ("/a", "/b", "/a", "/c"):
        r.upsert(row(p))
    assert [x.path for x in r.list().collect()] == ["/a", "/b", "/c"] and len(versions(spark, str(home))) == 2
    for lost in ("v-00000000000000000001", "v-99999999999999999999"):  # writers that never came to their mark
        (home / lost).mkdir()
        (home / lost / "part-0.json").write_text("{")
    assert [x.path for x in r.list().collect()] == ["/a", "/b", "/c"]
    r.delete("/b")
    assert [x.path for x in r.list().collect()] == ["/a", "/c"] and not (home / "v-00000000000000000001").exists() and (home / "v-99999999999999999999").exists()
    newest = home / versions(spark, str(home))[-1]
    for part in Path(newest).glob("part-*"):
        part.write_text("{not json")
    for crc in Path(newest).glob(".*.crc"):
        crc.unlink()
    assert [x.path for x in r.list().collect()] == ["/a", "/b", "/c"] and (home / f"corrupt-{newest.name}").exists()


def test_tokens_as_rows(base, spark):
    path = f"{ROOT}/pay/pay.go"
    rows = token_rows(base["files"], spark.createDataFrame([(path, 5, 8)], "path string, start int, end int")).orderBy("place").collect()
    assert [r.token for r in rows] == ["func", "Charge", "n", "int", "error", "return", "validate", "n"] and {r.row for r in rows} == {5, 6}


def test_references_and_paths():
    assert parse_ref("file:///a/b/") == "/a/b" and parse_ref("/a//b") == "/a/b"
    for bad in ("a/b", "/a/../b", "/a/%2e%2e/b", "/a/%252e%252e/b", "http://x/y", "file://host/x"):
        with pytest.raises(ValueError):
            parse_ref(bad)
    assert extract_paths({"filePath": "x.go", "q": "word", "deep": [{"root": "/r"}, "/abs/p"]}) == ["x.go", "/r", "/abs/p"]


def test_named_operations(base):
    ops = default_operations(base, ROOT)
    assert len(ops.list()) == 4
    assert {r.kind for r in ops.run("overview-shallow", op="ignored").collect()} == {"REPO", "PACKAGE", "FILE"}
    assert ops.run("who-calls", node="fn:pay.Charge").first().target_id == "meth:shop.Cart.Checkout"
    assert ops.run("busiest", top=1).count() == 1 and ops.run("find-functions", query="refund").count() == 1
    with pytest.raises(LookupError):
        ops.run("nope")
    with pytest.raises(ValueError):
        NamedOperations({}).add("a", "b")


def test_command_line(spark, tmp_path):
    import io

    from sievework.__main__ import main

    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.go").write_text("package a\n\n// Pay pays.\nfunc Pay() { check() }\n\nfunc check() {}\n")

    def run(*args):
        out = io.StringIO()
        assert main(list(args), spark, out) == 0
        return json.loads(out.getvalue())

    root = str(tmp_path / "src")
    assert [x["kind"] for x in run("overview", root)] == ["REPO", "PACKAGE", "FILE", "FUNCTION", "FUNCTION"]
    assert run("hybrid", root, "pay", "--channels", "structural,bm25")[0]["id"] == "fn:Pay"
    assert set(run("hybrid", root, "pay", "--channels", "bm25", "--explain")) == {"bm25"}
    assert run("chunk", root, str(tmp_path / "out"))["chunks"] == 2


@pytest.mark.parametrize("name", ["code_chunks", "code_detect_changes", "code_references", "code_edit_impact", "code_resolve", "code_hybrid", "code_node_edges", "code_traverse", "code_import_graph", "source_callers"])
def test_files_are_extracted_once(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan  # it reads stored records; before, every relation of the plan extracted all files again


def test_records_of_a_file_need_no_join(spark):
    texts = {f"p{k}/f{k}.go": f"package p{k}\n\n// Says {k}.\nfunc F{k}() {{ g{k}() }}\n" for k in range(30)}
    got = base_relations(files_relation(raw_files(spark, texts), ROOT, max_files=None)[0], cache=False)
    assert {(r.id, r.doc) for r in got["symbols"].collect()} == {(f"fn:p{k}.F{k}", f"Says {k}.") for k in range(30)}
    assert {(r.caller_id, r.callee_name) for r in got["call_sites"].collect()} == {(f"fn:p{k}.F{k}", f"g{k}") for k in range(30)}
    assert "Join" not in got["symbols"]._jdf.queryExecution().optimizedPlan().toString()


def test_tests_of_a_symbol_are_no_product_of_tasks(base, spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    one = spark.createDataFrame([("meth:shop.Cart.Add",), ("fn:pay.Charge",)], "id string")
    assert "CartesianProduct" not in plan(edges.tests(base["symbols"], only=one))
    whole = edges.tests(base["symbols"].unionAll(base["symbols"].where("path LIKE '%_test.go'").withColumn("id", F.lit("fn:shop.A"))), only=one)
    few = edges.tests(base["symbols"].unionAll(base["symbols"].where("path LIKE '%_test.go'").withColumn("id", F.lit("fn:shop.A"))), only=one, first=1)
    assert whole.count() == 4 and sorted((r.source_id, r.target_id) for r in few.collect()) == [("fn:pay.Charge", "fn:shop.A"), ("meth:shop.Cart.Add", "fn:shop.A")]


def test_renames_look_only_at_their_names(base, spark):
    got = edges.edit_impact(base, spark.createDataFrame([("fn:pay.Charge", "helper"), ("fn:shop.helper", "Add")], "id string, new_name string"))
    assert {r.id: (r.callers, r.tests, r.conflicts, r.safe_to_rename) for r in got.collect()} == {
        "fn:pay.Charge": (["meth:shop.Cart.Checkout"], ["fn:shop.TestAdd"], ["fn:shop.helper"], False), "fn:shop.helper": ([], ["fn:shop.TestAdd"], ["meth:shop.Cart.Add"], False)}
    only = edges.callers(base["symbols"], base["call_edges"], only=spark.createDataFrame([("fn:pay.Charge",)], "id string"))
    assert {r.source_id for r in only.collect()} == {"fn:pay.Charge"}


def test_a_name_is_resolved_by_one_scan(base, spark):
    for path, ids in (("pay.Charge", ["fn:pay.Charge"]), ("fn:pay.Charge", ["fn:pay.Charge"]), ("other.Charge", ["fn:pay.Charge"]), ("a.shop.Add", ["meth:shop.Cart.Add"]), ("nope", [])):
        got = names.resolve(base["symbols"], path)
        assert [r.id for r in got.collect()] == ids and "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_an_id_does_not_meet_all_symbols_of_its_name(spark):
    rows = [(f"fn:q{k}.main", "main", f"q{k}", "", "FUNCTION", "fn", f"/q{k}/{j}.go", j, j, j + 1, "function_declaration") for k in range(9) for j in range(3)]
    s = spark.createDataFrame(rows, "id string, name string, pkg string, receiver string, kind string, id_kind string, path string, seq int, start_row int, end_row int, grammar_kind string")
    files = s.select(F.col("path").alias("rel_path"), "path", F.lit(9).alias("line_count"))
    got = edges.locate(s, files, spark.createDataFrame([("fn:q4.main",), ("fn:x.main",), ("class:q4.main",)], "id string"))
    assert {r.id: r.path for r in got.collect()} == {"fn:q4.main": "/q4/0.go", "fn:x.main": "/q0/0.go", "class:q4.main": None}
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_step_makes_the_edges_of_its_nodes_alone(base, spark):
    asked = []

    def out(nodes):
        asked.append(sorted(r.id for r in nodes.collect()))
        return edges.callees(base["symbols"], base["call_edges"], only=nodes).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))

    whole = edges.callees(base["symbols"], base["call_edges"]).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    seeds = traverse.normalise_seeds(start="meth:shop.Cart.Checkout")
    got, same = (sorted(traverse.traverse({"C": r}, seeds, ["C"], 3).rows.collect()) for r in (out, whole))
    assert got == same and [r.target for r in got] == ["fn:pay.Charge", "fn:pay.validate"]
    assert asked == [["meth:shop.Cart.Checkout"], ["fn:pay.Charge"], ["fn:pay.validate"]]
    only = edges.callees(base["symbols"], base["call_edges"], only=spark.createDataFrame([("fn:pay.Refund",), ("fn:none",)], "id string"))
    assert {(r.source_id, r.target_id) for r in only.collect()} == {("fn:pay.Refund", "fn:pay.validate")}


def test_imported_names_are_looked_up_once(spark):
    files = spark.createDataFrame([("/a/1", "a"), ("/a/0", "a"), ("/b/2", "x.b"), ("/c/3", "y.b"), ("/r/4", "r")], "path string, pkg string")
    rows = [("/r/4", "a"), ("/r/4", "b"), ("/a/1", "../none"), ("/c/3", "./b"), ("/c/3", "none"), ("/gone", "a"), ("/a/0", None), ("/r/4", "a")]
    got = architecture.resolve_imports(spark.createDataFrame(rows, "path string, import_path string"), files)
    assert sorted(got.collect()) == [("/a/1", "/a/0"), ("/c/3", "/c/3"), ("/r/4", "/a/0"), ("/r/4", "/b/2")]
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()  # before, every import of every file was ranked with its packages


def test_docs_are_found_where_the_text_is(spark):
    from sievework.operators.tree import doc_of
    from sievework.sources.lexers import doc_above

    ends = ("", " ", "\t", "\r", "\x0b", "\u00a0", "\x85", " \x85", "\u2028 ")
    texts = ["", "x", "// a\n\n// b\n\n\nf"] + [f"x\n{e}// a{e}\n{e}//{e}b\n{e}\nf\n//c{e}\ng{e}" for e in ends]
    rows = [(t, k) for t in texts for k in range(9)]
    got = spark.createDataFrame(rows, "text string, row int").select("text", "row", doc_of(F.col("text"), F.col("row")).alias("doc")).collect()
    assert [(r.text, r.row, doc_above(r.text.split("\n"), r.row)) for r in got] == [tuple(r) for r in got]
    plan = base_relations(files_relation(raw_files(spark), ROOT, max_files=None)[0], cache=False)["symbols"]._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan  # before, every declaration went over all lines above it, in a text that came back with each record


def test_derived_files_are_dealt_by_their_number(spark, tmp_path, sf_dir):
    from sievework.plans.source_tree import LEAST, derived_files

    spark.range(4 * LEAST).selectExpr("id AS doc_id", "'s' AS source").write.parquet(f"{tmp_path}/documents.parquet")
    assert derived_files(spark, str(tmp_path)).rdd.getNumPartitions() == 4  # before, Spark merged them by the size of the ids or texts
    assert derived_files(spark, str(tmp_path)).count() == 4 * LEAST


def test_a_name_is_resolved_without_a_table_of_records(spark, sf_dir, monkeypatch):
    from sievework.sources import extract

    monkeypatch.setattr(extract, "stored", None)
    assert [r.id for r in QUERIES["code_resolve"](spark, sf_dir).collect()] == ["fn:pay.Charge"]


def test_edges_of_a_node_do_not_make_all_calls_distinct(base, spark):
    id_ = spark.createDataFrame([("fn:pay.Refund",)], "id string")
    rel = edges.relations(base, id_, first=9)
    assert {k: {(r.source_id, r.target_id) for r in rel[k].collect()} for k in ("CALLEES", "CALLERS")} == {"CALLEES": {("fn:pay.Refund", "fn:pay.validate")}, "CALLERS": set()}
    twice = base | {"call_sites": base["call_sites"].unionAll(base["call_sites"])}
    for node in ("fn:pay.Refund", "fn:pay.Charge", "fn:pay.validate"):
        one, two = (sorted(edges.node_edges(b, node)[0].drop("provenance").collect()) for b in (base, twice))
        assert one == two and one
    names_ = [edges.relations(base | {"call_edges": None}, id_, first=9)[k].columns for k in ("CALLEES", "CALLERS")]  # call_edges are not read
    assert names_ == [edges.EDGE_COLUMNS] * 2


def test_calls_of_a_caller_are_asked_for_before_they_are_dealt(base):
    plan = base["call_edges"].where("caller_id = 'x'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter")
