"""Edges between symbols by name: callees, callers, tests, imports and overrides, and lookups of symbols by id."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..semantics import DEFAULT, Semantics

KINDS = ("CALLEES", "CALLERS", "TESTS", "IMPORTS", "OVERRIDES")
#: Declared by the schema, produced by no relation.
DECLARED_ONLY = ("TESTS_OF",)
DEFAULT_KINDS = ("CALLERS", "CALLEES", "TESTS")
PER_KIND, SCAN = 50, 4
# How sure each relation is.
CONFIDENCE = {"CALLEES": 0.5, "CALLERS": 0.5, "TESTS": 0.7, "IMPORTS": 0.4, "OVERRIDES": 0.4, "RESOLVED": 1.0}
EDGE_COLUMNS = ["edge_kind", "source_id", "target_id", "target_kind", "target_summary", "location", "confidence", "provenance"]


def _edge(kind: str, source: Column, target: Column, target_kind: Column, summary: Column, file: Column, start: Column, end: Column, confidence: float | None = None, tool: str = "syntax") -> list[Column]:
    return [
        F.lit(kind).alias("edge_kind"), source.alias("source_id"), target.alias("target_id"), target_kind.alias("target_kind"), summary.alias("target_summary"),
        F.struct(file.alias("file"), start.alias("start"), end.alias("end")).alias("location"), F.lit(CONFIDENCE[kind] if confidence is None else confidence).alias("confidence"),
        F.struct(F.lit(tool).alias("tool"), F.lit("1").alias("version"), F.lit(None).cast("timestamp").alias("fetched_at"), F.lit("" if tool != "syntax" else "no resolved edges").alias("fallback")).alias("provenance"),
    ]


def _dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    return df.repartition(tasks, *keys) if tasks else df


def callees(symbols: DataFrame, calls: DataFrame, tasks: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """Each call with every symbol of the called name; one edge per caller and target; the place is the caller's. With ``only`` (id), the
    calls of these symbols, which are sent to every task.

    Rows stay narrow until they are distinct. With ``tasks`` they are dealt to so many at each step, so that a task's memory does not depend on the number that Spark chooses."""
    c = calls.select("callee_name", "caller_id", "path", "caller_start_row")
    s = symbols.select(F.col("name").alias("callee_name"), F.col("id").alias("sid"), F.col("kind").alias("skind"), F.col("summary").alias("ssum"), F.concat_ws(".", "pkg", "name").alias("dup"))
    place = ["caller_id", "path", "caller_start_row"]
    owner = symbols.select(F.col("id").alias("caller_id"), "path", F.col("start_row").alias("caller_start_row"), F.col("end_row").alias("ce"))
    if only is not None:
        asked = F.broadcast(only.select(F.col("id").alias("caller_id")).distinct())
        c, owner = c.join(asked, "caller_id", "left_semi"), owner.join(asked, "caller_id", "left_semi")
    both = _dealt(c, tasks, "callee_name").join(_dealt(s, tasks, "callee_name"), "callee_name").drop("callee_name")
    both = _dealt(both, tasks, *place).join(_dealt(owner, tasks, *place), place)
    one = _dealt(both, tasks, "caller_id", "dup").dropDuplicates(["caller_id", "dup"])
    return one.select(*_edge("CALLEES", F.col("caller_id"), F.col("sid"), F.col("skind"), F.col("ssum"), F.col("path"), F.col("caller_start_row"), F.col("ce")))


def callers(symbols: DataFrame, calls: DataFrame, resolved: DataFrame | None = None, only: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Functions and methods of other files that call a symbol's name; with ``only`` (id), the name of one of these symbols, which are sent to every task.

    ``resolved`` (source_id, target_id, file, start, end) answers from a language server; where it has a symbol, its rows
    replace the symbol's syntactic ones. ``tasks`` as in ``callees``.
    """
    place = ["caller_id", "path", "caller_start_row"]
    c = calls.select("callee_name", *place)
    s = (symbols if only is None else symbols.join(only.select("id").distinct(), "id", "left_semi")).select(F.col("name").alias("callee_name"), F.col("id").alias("sid"), F.col("path").alias("sp"))
    who = symbols.where(F.col("kind").isin("FUNCTION", "METHOD")).select(F.col("id").alias("caller_id"), F.col("kind").alias("wkind"), F.col("summary").alias("wsum"), "path", F.col("start_row").alias("caller_start_row"), F.col("end_row").alias("we"))
    both = c.join(F.broadcast(s), "callee_name") if only is not None else _dealt(c, tasks, "callee_name").join(_dealt(s, tasks, "callee_name"), "callee_name")
    both = _dealt(both.where("sp <> path").select("sid", *place), tasks, *place).join(_dealt(who, tasks, *place), place)
    # distinct by the columns of the place, not by a struct of them: then rows are where they are needed
    one = both.dropDuplicates(["sid", *place, "we"])
    out = one.select(*_edge("CALLERS", F.col("sid"), F.col("caller_id"), F.col("wkind"), F.col("wsum"), F.col("path"), F.col("caller_start_row"), F.col("we")))
    if resolved is None:
        return out
    kinds = symbols.select(F.col("id").alias("target_id"), F.col("kind"), F.col("summary")).dropDuplicates(["target_id"])
    sure = resolved.join(kinds, "target_id", "left").select(*_edge("CALLERS", F.col("source_id"), F.col("target_id"), F.col("kind"), F.col("summary"), F.col("file"), F.col("start"), F.col("end"), CONFIDENCE["RESOLVED"], "language server"))
    return sure.unionByName(out.join(sure.select("source_id").distinct(), "source_id", "left_anti"))


def tests(symbols: DataFrame, calls: DataFrame | None = None, only: DataFrame | None = None, semantics: Semantics = DEFAULT, first: int | None = None) -> DataFrame:
    """Symbols of test files as tests of the symbols in ``only`` (id), each with each, or only of what they call (then of all symbols
    if ``only`` is left out). Each with each is for the few symbols that are asked for, which are sent to every task: ValueError without ``only``.
    A caller that keeps no more than the ``first`` targets of each symbol, in order of id, says so: all symbols have the same ones then."""
    if semantics.tests_per_symbol and only is None:
        raise ValueError("name the symbols whose tests are wanted, or relate tests to what they call")
    t = symbols.where(F.col("path").endswith("_test.go")).alias("t")
    wanted = (symbols if only is None else symbols.join(only.select("id").distinct(), "id", "left_semi")).where("name <> ''").select(F.col("id").alias("sid"), F.col("name").alias("sname")).distinct()
    if semantics.tests_per_symbol:
        if first is not None:
            t = t.orderBy("id").limit(first).alias("t")
        both = t.join(F.broadcast(wanted))
    else:
        called = calls.select(F.col("caller_id"), F.col("callee_name")).distinct()
        both = t.join(called, F.col("t.id") == F.col("caller_id")).join(wanted, F.col("callee_name") == F.col("sname"))
    return both.select(*_edge("TESTS", F.col("sid"), F.col("t.id"), F.col("t.kind"), F.col("t.summary"), F.col("t.path"), F.col("t.start_row"), F.col("t.end_row")))


def imports(symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """The packages that a symbol's file imports."""
    i, s = imported.dropDuplicates(["path", "import_path"]).alias("i"), symbols.alias("s")
    return s.join(i, F.col("s.path") == F.col("i.path")).select(*_edge("IMPORTS", F.col("s.id"), F.concat(F.lit("pkg:"), "i.import_path"), F.lit("PACKAGE"), F.concat(F.lit("Package: "), "i.import_path"), F.col("i.path"), F.col("i.start_row"), F.col("i.end_row")))


def overrides(symbols: DataFrame, inherits: DataFrame) -> DataFrame:
    """Methods of the same name of a method's parents in the same file."""
    m, h, p = symbols.where("kind = 'METHOD'").alias("m"), inherits.alias("h"), symbols.where("kind = 'METHOD'").alias("p")
    both = m.join(h, (F.col("m.path") == F.col("h.path")) & (F.col("m.receiver") == F.col("h.class_name")))
    both = both.join(p, (F.col("p.path") == F.col("m.path")) & (F.col("p.receiver") == F.col("h.parent_name")) & (F.col("p.name") == F.col("m.name")))
    return both.select(*_edge("OVERRIDES", F.col("m.id"), F.col("p.id"), F.col("p.kind"), F.col("p.summary"), F.col("p.path"), F.col("p.start_row"), F.col("p.end_row")))


def relations(base: dict[str, DataFrame], only: DataFrame | None = None, semantics: Semantics = DEFAULT, first: int | None = None) -> dict[str, DataFrame]:
    """All edge relations of a project's base relations; tests are those of the symbols in ``only``, else those of what they call.
    With ``first`` the edges are for looking up the symbols in ``only``, and for no more than so many of a kind: callers and callees are theirs alone,
    found among all call sites, as the few that fit are made distinct at the end."""
    s, c = base["symbols"], base["call_edges"]
    near = semantics if only is not None else replace(semantics, tests_per_symbol=False)
    few, sites = (None, c) if first is None else (only, base.get("call_sites", c))
    return {"CALLEES": callees(s, sites, only=few), "CALLERS": callers(s, sites, base.get("resolved_edges"), few), "TESTS": tests(s, c, only, near, first), "IMPORTS": imports(s, base["imports"]), "OVERRIDES": overrides(s, base["inherits"])}


def cap_per_kind(edges: DataFrame, limit: int, kind: str = "edge_kind", order: tuple[str, ...] = ("target_id",), group: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """At most ``limit`` edges of each kind, and (kind, total_count, truncated). Counts look at 4 times the limit."""
    w = W.partitionBy(*group, kind).orderBy(*order)
    ranked = edges.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= SCAN * limit)
    counts = ranked.groupBy(*group, kind).agg(F.count("*").alias("total_count")).withColumn("truncated", F.col("total_count") > limit)
    return ranked.where(F.col("__k") <= limit).drop("__k"), counts


def node_edges(base: dict[str, DataFrame], node_id: str, kinds: tuple[str, ...] = DEFAULT_KINDS, limit: int = PER_KIND, semantics: Semantics = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The edges of one node, per kind at most ``limit``, and their counts."""
    spark = base["symbols"].sparkSession
    rel = relations(base, spark.createDataFrame([(node_id,)], "id string"), semantics, SCAN * limit)
    out = None
    for k in dict.fromkeys(x.upper() for x in kinds):
        if k in rel:
            one = rel[k].where(F.col("source_id") == node_id)
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no known edge kind")
    return cap_per_kind(out, limit)


def references(base: dict[str, DataFrame], ref: str, kinds: tuple[str, ...] = DEFAULT_KINDS, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Edges of the first symbol that an id or a glob name stands for; unknown kinds are ignored."""
    from .names import find_symbol

    by_id = base["symbols"].where(F.col("id") == ref)
    row = by_id.orderBy("path", "seq").first() or find_symbol(base["symbols"], ref, limit=1).first()
    if row is None:
        raise LookupError(f"no symbol {ref!r}")
    return node_edges(base, row["id"], tuple(k for k in kinds if k.upper() in KINDS) or DEFAULT_KINDS, limit)


def edit_impact(base: dict[str, DataFrame], renames: DataFrame, limit: int = 100) -> DataFrame:
    """Per rename (id, new_name): callers, tests and conflicts (symbols of any package that have the new name), safe_to_rename."""
    s = base["symbols"]
    rel = relations(base, renames.select("id"), first=limit)
    ids = lambda e, name: cap_per_kind(e, limit, group=("source_id",))[0].groupBy(F.col("source_id").alias("id")).agg(F.array_sort(F.collect_set("target_id")).alias(name))
    wanted = renames.select("id").distinct()
    near = lambda k: rel[k].join(wanted, F.col("source_id") == F.col("id"), "left_semi")
    # once per name, so that many renames to one name share its list, and the count alone needs no list
    asked = s.join(renames.select(F.col("new_name").alias("name")).distinct(), "name", "left_semi")
    taken = asked.groupBy(F.col("name").alias("new_name")).agg(F.array_sort(F.collect_set("id")).alias("conflicts"), F.count("id").alias("__taken"))
    out = renames.join(ids(near("CALLERS"), "callers"), "id", "left").join(ids(near("TESTS"), "tests"), "id", "left").join(taken, "new_name", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({c: F.coalesce(c, none) for c in ("callers", "tests", "conflicts")})
    rest = [c for c in renames.columns if c not in ("id", "new_name")]
    return out.select("id", "new_name", *rest, "callers", "tests", "conflicts", (F.coalesce("__taken", F.lit(0)) == 0).alias("safe_to_rename"))


def locate(symbols: DataFrame, files: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, path, start_row, end_row, found) of ids (id).

    Files are found as a whole. Functions and classes are found by package and name, else by name alone, plain declarations first.
    A method is found if its package has a class of the receiver's name, and that class's file a method with this receiver
    and name. Packages and repositories are not found. The first by path and place is taken.
    """
    i = ids.select("id").distinct().withColumns({"k": F.substring_index("id", ":", 1), "body": F.expr("substring(id, instr(id, ':') + 1)")})
    f = i.where("k = 'file'").join(files.select(F.col("rel_path").alias("body"), "path", F.lit(0).alias("start_row"), F.col("line_count").alias("end_row")), "body").select("id", "path", "start_row", "end_row")
    named = i.where("k IN ('fn', 'meth', 'class')").withColumn("p", F.split("body", "[.]"))
    front = lambda drop: F.array_join(F.slice("p", F.lit(1), F.greatest(F.size("p") - drop, F.lit(0))), ".")
    named = named.withColumns({"name": F.element_at("p", -1), "front": front(1), "owner": F.coalesce(F.get("p", F.size("p") - 2), F.lit("")), "owner_pkg": front(2)})
    s = symbols.select(F.col("name").alias("sname"), F.col("pkg").alias("spkg"), F.col("id_kind").alias("sk"), "kind", F.col("receiver").alias("recv"), "path", "start_row", "end_row", "seq", "grammar_kind")
    plain = F.when(F.col("grammar_kind").isin("function_declaration", "type_declaration"), 0).otherwise(1)
    # the first of a name in each package, and of these the first of all: an id meets two rows, however many symbols share its name
    in_pkg = s.where("sk <> 'meth'").groupBy("sname", "sk", "spkg").agg(F.min(F.struct(plain.alias("plain"), "path", "seq", "start_row", "end_row")).alias("near"))
    anywhere = in_pkg.groupBy("sname", "sk").agg(F.min("near").alias("far"))
    by_name = named.where("k <> 'meth'").join(anywhere, (F.col("name") == F.col("sname")) & (F.col("k") == F.col("sk"))).select("id", "name", "k", "front", "far")
    by_name = by_name.join(in_pkg, (F.col("name") == F.col("sname")) & (F.col("k") == F.col("sk")) & (F.col("front") == F.col("spkg")), "left").select("id", F.coalesce("near", "far").alias("one"))
    homes = s.where("kind = 'CLASS'").select(F.col("sname").alias("owner"), F.col("spkg").alias("owner_pkg"), F.col("path").alias("home")).distinct()
    methods = s.where("kind = 'METHOD'").select(F.col("sname").alias("name"), F.col("recv").alias("owner"), "path", "start_row", "end_row", "seq")
    of_class = named.where("k = 'meth'").join(homes, ["owner", "owner_pkg"]).join(methods, ["name", "owner"]).where("path = home").groupBy("id").agg(F.min(F.struct("path", "seq", "start_row", "end_row")).alias("one"))
    first = by_name.select("id", "one.path", "one.start_row", "one.end_row").unionByName(of_class.select("id", "one.path", "one.start_row", "one.end_row"))
    found = f.unionByName(first)
    return i.select("id").join(found, "id", "left").withColumn("found", F.col("path").isNotNull())


def graph_schema(spark: SparkSession) -> DataFrame:
    """(what, name, detail): node kinds, edge kinds, layers and the id kind of each node kind."""
    # The names of the graph's vocabulary.
    nodes = {"REPO": "repo", "PACKAGE": "pkg", "FILE": "file", "CLASS": "class", "FUNCTION": "fn", "METHOD": "meth", "MODULE": "module"}
    rows = [("node", k, v) for k, v in nodes.items()] + [("edge", k, "") for k in (*KINDS, *DECLARED_ONLY)] + [("layer", x, "") for x in ("summary", "signature", "doc", "types", "body", "source")]
    return spark.createDataFrame(rows, "what string, name string, detail string")
