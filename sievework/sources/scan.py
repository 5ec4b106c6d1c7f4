"""Scanning source trees into the ``files`` relation, with load errors as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FILES = 50_000
MAX_FILE_BYTES = 8 << 20
# File name extensions of the languages, in order of priority.
LANGUAGES = {
    "go": ("go",),
    "typescript": ("ts", "tsx", "mts", "cts"),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "python": ("py", "pyi"),
    "rust": ("rs",),
    "php": ("php", "phtml", "php3", "php4", "php5", "phps"),
}
SKIPPED = ("vendor", "node_modules")


def language(path: Column) -> Column:
    """Language by the last extension, in any case; null for an unknown one."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for name in reversed(LANGUAGES):
        out = F.when(ext.isin(*LANGUAGES[name]), name).otherwise(out)
    return out


def package_of(rel_path: Column) -> Column:
    """Directory part joined by dots; '' at the root."""
    return F.regexp_replace(F.regexp_replace(rel_path, r"/?[^/]*$", ""), "/", ".")


def walked(rel_path: Column) -> Column:
    """Whether a walk reaches a file: no hidden, vendored or installed directory above it."""
    return ~rel_path.rlike(r"(^|/)(\.[^/]*|" + "|".join(SKIPPED) + r")/")


def _local(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^file:/*(?=/)", ""), r"^file:", "")


def files_relation(raw: DataFrame, root: str, project: str | None = None, max_files: int | None = MAX_FILES, max_bytes: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files, errors) of raw files (path, content binary, length, mtime_ns) below ``root``.

    Unknown extensions are passed over; files above ``max_bytes`` and files beyond ``max_files`` (in order of path) are errors.
    """
    base = root.rstrip("/")
    rel = F.expr(f"substring(path, {len(base) + 2})")
    known = raw.withColumn("rel_path", rel).where(walked(F.col("rel_path"))).withColumn("lang", language(F.col("path"))).where("lang IS NOT NULL")
    errors = known.where(F.col("length") > max_bytes).select("path", F.lit("the file is too large").alias("error"))
    good = known.where(F.col("length") <= max_bytes)
    if max_files:
        paths = good.select("path").orderBy("path").limit(max_files + 1)
        within = paths.orderBy("path").limit(max_files)
        errors = errors.unionAll(paths.join(within, "path", "left_anti").select("path", F.lit("the walk stopped: too many files").alias("error")))
        good = good.join(within, "path", "left_semi")
    text = F.make_valid_utf8(F.col("content").cast("string"))
    lines = F.when(text == "", 0).otherwise(F.size(F.split(text, "\n")) - F.when(text.endswith("\n"), 1).otherwise(0))
    files = good.select(F.lit(project or base).alias("project"), "path", "rel_path", package_of(F.col("rel_path")).alias("pkg"), "lang", "content", text.alias("text"), "mtime_ns", lines.cast("int").alias("line_count"))
    return files, errors


def scan(spark: SparkSession, root: str, project: str | None = None, max_files: int | None = MAX_FILES, max_bytes: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files, errors) of a source tree, by the binary file source; large files are pruned before they are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    small = raw.where(F.col("length") <= max_bytes)
    large = raw.where(F.col("length") > max_bytes).select(_local(F.col("path")).alias("path"), F.lit(None).cast("binary").alias("content"), "length", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    rows = small.select(_local(F.col("path")).alias("path"), "content", "length", (F.unix_micros("modificationTime") * 1000).alias("mtime_ns")).unionAll(large)
    return files_relation(rows, root, project, max_files, max_bytes)


def root_module(spark: SparkSession, root: str) -> str:
    """The module line of the root's go.mod, or ''."""
    try:
        rows = spark.read.text(f"{root.rstrip('/')}/go.mod").where(F.col("value").startswith("module ")).limit(1).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return ""
    return rows[0]["value"][7:].strip() if rows else ""
