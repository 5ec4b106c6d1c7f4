"""Trees within a byte budget, and the layers of a node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip
from .intervals import slice_rows, slice_with_trivia

BUDGET, NODE_COST = 16 * 1024, 256
LAYERS = ("summary", "signature", "doc", "types", "body")


def budgeted(nodes: DataFrame, order: list[str], budget: int = BUDGET, id_col: str = "id", summary_col: str = "summary") -> DataFrame:
    """Nodes in order as long as the running cost (id and summary bytes and 256 each) stays within the budget.

    Costs are positive, so the first overflow ends the list. Only as many rows as the budget could ever hold are ranked.
    """
    most = budget // NODE_COST + 1
    cost = F.octet_length(F.col(id_col)) + F.octet_length(F.col(summary_col)) + NODE_COST
    head = nodes.withColumn("cost", cost.cast("long")).orderBy(*order).limit(most)
    return head.withColumn("spent", F.sum("cost").over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).where(F.col("spent") <= budget)


def overview(base: dict[str, DataFrame], root: str, depth: int = 2, scope: str | None = None, budget: int = BUDGET) -> DataFrame:
    """(id, parent_id, kind, summary, depth, cost, spent): repository, packages, files, symbols in preorder, within the budget."""
    files, symbols = base["files"], base["symbols"]
    if scope:
        files, symbols = files.where(F.col("path").startswith(scope)), symbols.where(F.col("path").startswith(scope))
    pkg_id = F.concat(F.lit("pkg:"), F.when(F.col("pkg") == "", F.lit(root)).otherwise(F.col("pkg")))
    file_id = F.concat(F.lit("file:"), "rel_path")
    nothing = F.lit("")
    top = base["files"].sparkSession.range(1).select(F.lit(root).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("REPO").alias("kind"), F.lit("").alias("summary"), F.lit(0).alias("depth"), nothing.alias("o1"), nothing.alias("o2"), F.lit(-1).alias("o3"))
    out = top
    if depth >= 1:
        pkgs = files.select("pkg").distinct().select(pkg_id.alias("id"), F.lit(root).alias("parent_id"), F.lit("PACKAGE").alias("kind"), F.concat(F.lit("Package: "), "pkg").alias("summary"), F.lit(1).alias("depth"), F.concat(F.lit(" "), "pkg").alias("o1"), nothing.alias("o2"), F.lit(-1).alias("o3"))
        each = files.select(file_id.alias("id"), pkg_id.alias("parent_id"), F.lit("FILE").alias("kind"), F.concat(F.lit("File: "), F.element_at(F.split("rel_path", "/"), -1)).alias("summary"), F.lit(2).alias("depth"), F.concat(F.lit(" "), "pkg").alias("o1"), F.col("rel_path").alias("o2"), F.lit(-1).alias("o3"))
        out = out.unionByName(pkgs).unionByName(each)
    if depth >= 2:
        s = symbols.join(files.select("path", "rel_path"), "path")
        out = out.unionByName(s.select("id", F.concat(F.lit("file:"), "rel_path").alias("parent_id"), "kind", "summary", F.lit(3).alias("depth"), F.concat(F.lit(" "), "pkg").alias("o1"), F.col("rel_path").alias("o2"), F.col("seq").cast("int").alias("o3")))
    return budgeted(out, ["o1", "o2", "o3"], budget).drop("o1", "o2", "o3")


def doc_of(text: Column, start_row: Column) -> Column:
    """Comment lines (``//``) just above a declaration; blank lines directly above are passed over, one after a comment ends it."""
    above = F.reverse(F.slice(F.split(text, "\n"), F.lit(1), start_row))
    trimmed = F.transform(above, strip)
    state = F.aggregate(
        trimmed, F.struct(F.lit(True).alias("open"), F.array().cast("array<string>").alias("got")),
        lambda s, x: F.when(~s["open"], s)
        .when(x == "", F.when(F.size(s["got"]) > 0, F.struct(F.lit(False).alias("open"), s["got"].alias("got"))).otherwise(s))
        .when(~x.startswith("//"), F.struct(F.lit(False).alias("open"), s["got"].alias("got")))
        .otherwise(F.struct(F.lit(True).alias("open"), F.array_append(s["got"], x.substr(F.lit(3), F.length(x))).alias("got"))),
    )
    return F.when(start_row > 0, strip(F.array_join(F.reverse(state["got"]), "\n"))).otherwise(F.lit(""))


def statement_kind(line: Column) -> Column:
    """Kind of a trimmed line."""
    out = F.when(line.startswith("if "), "if").when(line.startswith("for "), "for").when(line.startswith("switch "), "switch").when(line.startswith("return"), "return")
    out = out.when(line.startswith("go "), "go").when(line.startswith("defer "), "defer").when(line.startswith("var ") | line.startswith("const "), "decl")
    return out.when(line.endswith("{") | line.endswith("}"), "block").otherwise("expr")


def strip_comments(line: Column) -> Column:
    return F.regexp_replace(F.substring_index(line, "//", 1), r"/\*.*?\*/", "")


def body_layer(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, seq, statements [kind, text], control): one statement for each line that is not blank; linear or branching."""
    s = symbols.join(files.select("path", F.col("text").alias("whole")), "path")
    lines = F.filter(F.transform(F.slice(F.split("whole", "\n"), F.col("start_row") + 1, F.col("end_row") - F.col("start_row")), lambda x: strip(strip_comments(x))), lambda x: x != "")
    s = s.where("end_row > start_row").withColumn("lines", lines)
    branch = F.exists("lines", lambda x: F.contains(x, F.lit("if ")) | x.startswith("switch ") | x.startswith("for ") | x.startswith("select "))
    return s.select("id", "path", "seq", F.transform("lines", lambda x: F.struct(statement_kind(x).alias("kind"), x.alias("text"))).alias("statements"), F.when(branch, "branching").otherwise("linear").alias("control"))


def hover_types(hover: Column) -> Column:
    """(params, result) of a signature: what stands in its first parentheses, and the rest."""
    return F.struct(F.regexp_extract(hover, r"\(([^)]*)\)", 1).alias("params"), strip(F.regexp_extract(hover, r"\([^)]*\)(.*)", 1)).alias("result"))


def nodes(base: dict[str, DataFrame], ids: DataFrame, layers: tuple[str, ...] = ("signature",), hover: DataFrame | None = None) -> DataFrame:
    """Nodes (id) with the layers asked for; others are null. ``hover`` (id, text) is a language server's answer."""
    for x in layers:
        if x not in LAYERS:
            raise ValueError(f"unknown layer {x!r}")
    s = base["symbols"].join(ids.select("id").distinct(), "id", "left_semi").join(base["files"].select("path", F.col("text").alias("whole")), "path")
    text = slice_rows(F.col("whole"), F.col("start_row"), F.col("end_row"))
    hovered = F.lit(None).cast("string")
    if hover is not None:
        s = s.join(hover.select("id", F.col("text").alias("hover")), "id", "left")
        hovered = F.col("hover")
    first = strip(F.element_at(F.split(text, "\n"), 1))
    label = F.element_at(F.split("summary", ": "), 1)
    null = F.lit(None).cast("string")
    out = s.select(
        "id", "kind", "path", "start_row", "end_row", "seq",
        (F.concat_ws(": ", label, first) if "summary" in layers else null).alias("summary"),
        (F.coalesce(hovered, text) if "signature" in layers else null).alias("signature"),
        (F.col("doc") if "doc" in layers else null).alias("doc"),
        (F.when(hovered.isNotNull(), hover_types(hovered)) if "types" in layers else F.lit(None).cast("struct<params:string,result:string>")).alias("types"),
    )
    if "body" in layers:
        out = out.join(body_layer(base["symbols"], base["files"]).select("id", "path", "seq", "statements", "control"), ["id", "path", "seq"], "left")
    return out


def node_source(base: dict[str, DataFrame], ids: DataFrame, start: int | None = None, end: int | None = None, trivia: bool = False) -> DataFrame:
    """(id, path, start, end, text): the source of nodes, or rows of it from 0, clamped to the node."""
    s = base["symbols"].join(ids.select("id").distinct(), "id", "left_semi").join(base["files"].select("path", F.col("text").alias("whole")), "path")
    a = F.greatest("start_row", F.lit(start)) if start is not None else F.col("start_row")
    b = F.least("end_row", F.lit(end)) if end is not None else F.col("end_row")
    cut = slice_with_trivia if trivia else slice_rows
    return s.select("id", "path", a.alias("start"), b.alias("end"), cut(F.col("whole"), a, b).alias("text"))


def symbols_overview(symbols: DataFrame, path: str) -> DataFrame:
    return symbols.where(F.col("path") == path).orderBy("seq")
