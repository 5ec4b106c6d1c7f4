"""Chunks of source for retrieval: by function, class or module, and sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import glob_regex, strip
from ..session import stored
from .intervals import slice_rows
from .pattern import is_test_file

WINDOW, STEP = 1000, 800


def windows(docs: DataFrame, keys: list[str], text_col: str, size: int = WINDOW, step: int = STEP, in_bytes: bool = False) -> DataFrame:
    """(keys, start, end, text): windows of ``size`` every ``step``; the first that reaches the end is the last.

    Positions count characters, or UTF-8 bytes (then ``text`` is binary). Empty texts have none.
    """
    body = F.encode(F.col(text_col), "utf-8") if in_bytes else F.col(text_col)
    n = F.octet_length(body) if in_bytes else F.length(body)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int"))
    rows = docs.where(F.length(text_col) > 0).select(*keys, body.alias("__body"), n.alias("__n"), F.explode(F.sequence(F.lit(0), last)).alias("__k"))
    start = F.col("__k") * step
    return rows.select(*keys, start.alias("start"), F.least(start + size, F.col("__n")).alias("end"), F.substring("__body", start + 1, F.lit(size)).alias("text"))


def baseline(files: DataFrame, size: int = WINDOW, step: int = STEP, include: list[str] | None = None, exclude: list[str] | None = None, with_tests: bool = False, languages: list[str] | None = None) -> DataFrame:
    """(id, file, start_line, end_line, start_byte, end_byte, text, policy): byte windows of the files that ``chunks`` would take; ids count over
    all of them in order.

    The running number is the sum of the windows of earlier files plus the place. Files are dealt out by ranges of their paths; a sum
    within each range is added to those of the ranges before, so that only one row for each range meets in one task. Lines are counted by adding up the
    line feeds of a file's steps, each of which is looked at once.
    """
    if not 0 < step <= size:
        raise ValueError("windows must touch: the step is 1 to the size")
    files = files.where(included(F.col("rel_path"), include, exclude, with_tests))
    if languages:
        files = files.where(F.col("lang").isin(languages))
    rows = windows(files.select("path", "rel_path", F.col("text").alias("whole")), ["path", "rel_path"], "whole", size, step, in_bytes=True)
    earlier = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    total = lambda c, w: F.coalesce(F.sum(c).over(earlier(w)), F.lit(0))
    ranged = stored(rows.groupBy("path").agg(F.count("*").alias("n")).repartitionByRange("path").withColumn("part", F.spark_partition_id()), "windows")
    heads = ranged.groupBy("part").agg(F.sum("n").alias("n")).withColumn("head", total("n", W.orderBy("part"))).drop("n")
    within = ranged.withColumn("own", total("n", W.partitionBy("part").orderBy("path")))
    per_file = within.join(F.broadcast(heads), "part").select("path", (F.col("head") + F.col("own")).alias("before"))

    def feeds(count: Column | int) -> Column:
        """Line feeds among the window's first bytes."""
        text = F.decode(F.substring("text", F.lit(1), count if isinstance(count, Column) else F.lit(count)), "iso-8859-1")
        return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))

    counted = rows.withColumns({"in_step": feeds(step), "in_window": feeds(F.col("end") - F.col("start") - 1)})
    counted = counted.withColumn("above", total("in_step", W.partitionBy("path").orderBy("start")))
    number = F.col("before") + (F.col("start") / step).cast("long")
    line = lambda c: (c + 1).cast("int")
    return counted.join(per_file, "path").select(
        F.concat_ws(":", F.lit("baseline"), "rel_path", number.cast("string")).alias("id"), F.col("path").alias("file"),
        line(F.col("above")).alias("start_line"), line(F.col("above") + F.col("in_window")).alias("end_line"), F.col("start").alias("start_byte"), F.col("end").alias("end_byte"),
        F.decode("text", "utf-8").alias("text"), F.lit("baseline").alias("policy"),
    )


def included(rel_path: Column, include: list[str] | None = None, exclude: list[str] | None = None, with_tests: bool = False) -> Column:
    """Whether a file is chunked: by globs on its relative path or its base name; test files only on demand."""
    base = F.element_at(F.split(rel_path, "/"), -1)

    def any_of(globs: list[str]) -> Column:
        out = F.lit(False)
        for g in globs:
            r = glob_regex(g)
            if r:
                out = out | rel_path.rlike(r) | base.rlike(r)
        return out

    ok = any_of(include) if include else F.lit(True)
    if exclude:
        ok = ok & ~any_of(exclude)
    return ok if with_tests else ok & ~is_test_file(rel_path)


def callers_of(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(name, callers): ids of all functions that call a symbol's name, in any file, sorted. Names that no symbol has are left out before lists are made."""
    known = calls.join(symbols.select(F.col("name").alias("callee_name")).distinct(), "callee_name", "left_semi")
    return known.groupBy(F.col("callee_name").alias("name")).agg(F.array_sort(F.collect_set("caller_id")).alias("callers"))


def callees_of(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """(caller_id, path, start_row, callees): each called name's symbol of the same file, else package, else the first; else a made-up id."""
    s = symbols.select(F.col("name"), F.col("id").alias("sid"), F.col("path").alias("sp"), F.col("pkg").alias("spkg"), F.col("seq"))
    c = calls.join(s, F.col("callee_name") == F.col("name"), "left")
    near = F.when(F.col("sp") == F.col("path"), 0).when(F.col("spkg") == F.col("pkg"), 1).otherwise(2)
    one = c.withColumn("__k", F.row_number().over(W.partitionBy("path", "caller_id", "caller_start_row", "callee_name").orderBy(near, "sp", "seq"))).where("__k = 1")
    made = F.concat(F.lit("fn:"), F.concat_ws(".", F.when(F.col("pkg") != "", F.col("pkg")), "callee_name"))
    return one.groupBy("caller_id", "path", F.col("caller_start_row").alias("start_row")).agg(F.array_sort(F.collect_set(F.coalesce("sid", made))).alias("callees"))


def chunks(base: dict[str, DataFrame], policies: tuple[str, ...] = ("function", "class"), include: list[str] | None = None, exclude: list[str] | None = None, with_tests: bool = False, languages: list[str] | None = None) -> DataFrame:
    """The chunk table: id, qualified_name, kind, language, file, start_line, end_line, signature, text, callers, callees, policy."""
    files = base["files"].where(included(F.col("rel_path"), include, exclude, with_tests))
    if languages:
        files = files.where(F.col("lang").isin(languages))
    s = base["symbols"].join(files.select("path", "rel_path", F.col("text").alias("whole"), "line_count"), "path")
    none = F.array().cast("array<string>")
    up, down = callers_of(base["symbols"], base["call_edges"]), callees_of(base["symbols"], base["call_edges"])
    doc_lines = F.when(F.col("doc") == "", 0).otherwise(F.size(F.split("doc", "\n")))
    body = slice_rows(F.col("whole"), F.greatest(F.col("start_row") - doc_lines, F.lit(0)), F.col("end_row"))
    bare = slice_rows(F.col("whole"), F.col("start_row"), F.col("end_row"))
    signature = strip(F.element_at(F.split(bare, "\n"), 1))
    full_sig = F.when(F.col("doc") != "", F.concat_ws("\n\n", "doc", "sig")).otherwise(F.col("sig"))
    qualified = F.concat_ws(".", F.when(F.col("pkg") != "", F.col("pkg")), F.when(F.col("receiver") != "", F.col("receiver")), "name")
    s = s.withColumns({"body": body, "sig": signature, "qualified_name": qualified})
    near = s.join(up, "name", "left").join(down, (s["id"] == down["caller_id"]) & (s["path"] == down["path"]) & (s["start_row"] == down["start_row"]), "left").select(s["*"], F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))
    held = ["id", "path", "pkg", "lang", "kind", "name", "receiver", "start_row", "end_row", "qualified_name", "body", "sig", "callers", "callees"]
    near = stored(near.withColumn("signature", full_sig).select(*held, "signature"), "near")  # every policy reads it, and its texts are cut out once
    shape = ["id", "qualified_name", "kind", F.col("lang").alias("language"), F.col("path").alias("file"), (F.col("start_row") + 1).alias("start_line"), F.col("end_row").alias("end_line"), "signature", F.col("body").alias("text"), "callers", "callees", "policy"]
    out = None
    add = lambda df: df if out is None else out.unionByName(df)
    if "function" in policies:
        out = add(near.where("kind IN ('FUNCTION', 'METHOD')").withColumn("policy", F.lit("function")).select(*shape))
    if "class" in policies:
        m = near.where("kind = 'METHOD'").groupBy(F.col("path").alias("mp"), F.col("receiver").alias("mr")).agg(F.array_sort(F.collect_list(F.struct("start_row", "sig", "callers", "callees"))).alias("methods"))
        c = near.where("kind = 'CLASS'").join(m, (F.col("path") == F.col("mp")) & (F.col("name") == F.col("mr")), "left")
        below = F.filter(F.coalesce("methods", F.array().cast(m.schema["methods"].dataType)), lambda x: x["start_row"] >= F.col("start_row"))
        c = c.withColumn("below", below)
        listed = F.array_join(F.transform("below", lambda x: x["sig"]), "\n")
        c = c.withColumn("body", F.when(F.size("below") > 0, F.concat(F.regexp_replace("body", r"\n+$", ""), F.lit("\n\nMethods:\n"), listed)).otherwise(F.col("body")))
        c = c.withColumns({"callers": F.array_sort(F.array_distinct(F.flatten(F.transform("below", lambda x: x["callers"])))), "callees": F.array_sort(F.array_distinct(F.flatten(F.transform("below", lambda x: x["callees"]))))})
        out = add(c.withColumn("policy", F.lit("class")).select(*shape))
    if "module" in policies:
        g = near.groupBy("path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("callers")))).alias("callers"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("callees")))).alias("callees"))
        name = F.concat_ws(".", F.when(F.col("pkg") != "", F.col("pkg")), "rel_path")
        f = files.where("line_count > 0").join(g, "path", "left")
        out = add(f.select(F.concat(F.lit("module:"), name).alias("id"), name.alias("qualified_name"), F.lit("MODULE").alias("kind"), F.col("lang").alias("language"), F.col("path").alias("file"), F.lit(1).alias("start_line"), F.col("line_count").alias("end_line"), F.col("rel_path").alias("signature"), slice_rows(F.col("text"), F.lit(0), F.col("line_count")).alias("text"), F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"), F.lit("module").alias("policy")))
    if out is None:
        raise ValueError("no known policy")
    return out


def write_ndjson(df: DataFrame, path: str) -> None:
    """One JSON object a line, in order of file, start line and name."""
    df.orderBy("file", "start_line", "qualified_name").write.json(path)
