"""Change impact: unified diffs, attribution of hunks to declarations, and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .edges import relations
from .intervals import attribute, merge

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
MAX_CHANGES, PER_CHANGE, LIST_CAP = 200, 20, 100


def parse_diff(lines: DataFrame, order: str = "n", text: str = "line", diff: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(hunks, summary) of unified diffs given as ordered lines; ``diff`` names a column if there are several. One diff is
    read in order by one task.

    Hunks (file, start, end, place) are rows [start, end) of the new side, from 0; deletions without new rows are no
    hunks. The summary (file, added, deleted, hunks, place) adds up the headers' counts.
    """
    keys = [diff] if diff else []
    w = W.partitionBy(*keys).orderBy(order) if keys else W.orderBy(order)
    marked = lines.where(F.col(text).rlike(r"^(\+\+\+ b/|@@)")).withColumn("file", F.last(F.when(F.col(text).startswith("+++ b/"), F.expr(f"substring({text}, 7)")), ignorenulls=True).over(w))
    number = lambda k: F.regexp_extract(text, HUNK, k)
    count = lambda k: F.when(number(k) == "", 1).otherwise(number(k).cast("int"))
    heads = marked.where(F.col(text).rlike(HUNK)).select(*keys, "file", F.col(order).alias("place"), (F.greatest(number(3).cast("int"), F.lit(1)) - 1).alias("start"), count(2).alias("old"), count(4).alias("new"))
    hunks = heads.where("new > 0").select(*keys, "file", "start", (F.col("start") + F.col("new")).alias("end"), "place")
    files = marked.where(F.col(text).startswith("+++ b/")).groupBy(*keys, "file").agg(F.min(order).alias("place"))
    sums = heads.groupBy(*keys, "file").agg(F.sum(F.when(F.col("new") > 0, F.col("new")).otherwise(0)).alias("added"), F.sum("old").alias("deleted"), F.sum((F.col("new") > 0).cast("int")).alias("hunks"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("added", "deleted", "hunks")}
    return hunks, files.join(sums, [*keys, "file"], "left").withColumns(zero)


def check_refs(base: str | None = None, since: str | None = None, head: str | None = None) -> tuple[str, str]:
    """(base, head) of a comparison: one of base and since, head by default HEAD, no name that starts with a dash."""
    if bool(base) == bool(since):
        raise ValueError("give either a base or since")
    refs = (base or since or "", head or "HEAD")
    for r in refs:
        if r.startswith("-") or not r.strip():
            raise ValueError(f"bad reference {r!r}")
    return refs


def diff_text(root: str, base: str, head: str = "HEAD") -> str:
    """The diff of added, copied and modified files, by a git process on the driver."""
    import subprocess

    a, b = check_refs(base=base, head=head)
    done = subprocess.run(["git", "-C", root, "diff", "--unified=0", "--diff-filter=ACM", f"{a}...{b}", "--"], capture_output=True, check=True)
    return done.stdout.decode("utf-8", "replace")


def match_files(hunks: DataFrame, files: DataFrame) -> DataFrame:
    """Hunks with the path of their file: by relative path, else by a base name that only one file has."""
    base = F.element_at(F.split("rel_path", "/"), -1)
    single = files.groupBy(base.alias("b")).agg(F.min("path").alias("by_base"), F.count("*").alias("n")).where("n = 1").drop("n")
    h = hunks.join(files.select(F.col("rel_path").alias("file"), "path"), "file", "left")
    return h.join(single, F.element_at(F.split("file", "/"), -1) == F.col("b"), "left").withColumn("path", F.coalesce("path", "by_base")).drop("b", "by_base")


def detect_changes(lines: DataFrame, base: dict[str, DataFrame], limit: int = MAX_CHANGES) -> DataFrame:
    """(order, file, id, ranges, callers, tests, overrides): rows of files without a declaration first, as they come in the
    diff, then declarations by id. Ranges are merged; lists hold at most ``LIST_CAP`` ids, from 20 edges each."""
    hunks, _ = parse_diff(lines)
    placed = match_files(hunks, base["files"])
    got = attribute(placed.select("path", "file", "start", "end", "place"), base["symbols"], "path", ["id"])
    ranges = merge(got.select("file", "id", "start", "end"), ["file", "id"])
    rows = ranges.groupBy("file", "id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    first = got.groupBy("file").agg(F.min("place").alias("place"))
    rows = rows.join(first, "file")
    rel = relations(base, rows.where("id IS NOT NULL").select("id"), first=PER_CHANGE)
    changed = rows.select("id").distinct()
    for name, kind in (("callers", "CALLERS"), ("tests", "TESTS"), ("overrides", "OVERRIDES")):
        e = rel[kind].join(changed, F.col("source_id") == F.col("id"), "left_semi")
        e = e.withColumn("k", F.row_number().over(W.partitionBy("source_id").orderBy("target_id"))).where(F.col("k") <= PER_CHANGE)
        lists = e.groupBy(F.col("source_id").alias("id")).agg(F.slice(F.array_sort(F.collect_set("target_id")), 1, LIST_CAP).alias(name))
        rows = rows.join(lists, "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    w = W.orderBy(F.col("id").isNotNull(), F.when(F.col("id").isNull(), F.col("place")), "id", "file")
    return rows.orderBy(F.col("id").isNotNull(), F.when(F.col("id").isNull(), F.col("place")), "id", "file").limit(limit).withColumn("order", F.row_number().over(w)).drop("place")
