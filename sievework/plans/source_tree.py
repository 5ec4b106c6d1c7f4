"""A source tree that Spark derives from ``documents``: a small file for every document, in one of six languages by its id.

A file declares a class with a method, and a function that calls that of the document six further on; it imports the package of another source. So the tree grows
with the table, and what the operators must find in it follows from the documents in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "/demo"
#: By doc_id % 6: ending and text; {h} is the id, {f} the id of the next file of the language, {p} the imported package, {s} the own one, {b} a base class.
FILES = [
    ("go", 'package {s}\n\nimport "example.com/demo/{p}"\n\ntype Doc{h} struct {{\n\tn int\n}}\n\nfunc (d *Doc{h}) Size() int {{\n\treturn {p}.Count(d.n)\n}}\n\nfunc Open{h}() int {{\n\treturn Open{f}()\n}}\n'),
    ("ts", 'import {{ count }} from "../{p}";\n\nexport class Doc{h} extends Base{b} {{\n  size() {{\n    return count();\n  }}\n}}\n\nexport function open{h}() {{\n  return open{f}();\n}}\n'),
    ("js", 'import {{ count }} from "../{p}";\n\nexport class Doc{h} extends Base{b} {{\n  size() {{\n    return count();\n  }}\n}}\n\nexport function open{h}() {{\n  return open{f}();\n}}\n'),
    ("rs", "use crate::{p};\n\npub struct Doc{h} {{\n    n: u32,\n}}\n\nimpl Doc{h} {{\n    pub fn size(&self) -> u32 {{\n        count(self.n)\n    }}\n}}\n\npub fn open{h}() -> u32 {{\n    open{f}()\n}}\n"),
    ("py", "import {p}\n\nclass Doc{h}(Base{b}):\n    def size(self):\n        return count()\n\ndef open{h}():\n    return open{f}()\n"),
    ("php", "<?php\nuse App\\{p};\n\nclass Doc{h} extends Base{b} {{\n    function size() {{\n        return count();\n    }}\n}}\n\nfunction open{h}() {{\n    return open{f}();\n}}\n"),
]


#: Files of a task, at most, and at least where there are fewer than two tasks for a core.
MOST, LEAST = 10_000, 500


def _tasks(spark: SparkSession, files: int) -> int:
    return max(1, -(-files // MOST), min(2 * spark.sparkContext.defaultParallelism, -(-files // LEAST)))


def derived_files(spark: SparkSession, d: str) -> DataFrame:
    """(path, content, length, mtime_ns) of the derived files; documents without an id have none."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id IS NOT NULL AND doc_id >= 0")
    # dealt to so many tasks here: ids are small, and Spark would merge the partitions of what becomes a text and its records
    docs = docs.select("doc_id", F.coalesce("source", F.lit("none")).alias("own")).repartition(_tasks(spark, docs.count()), "doc_id").dropDuplicates(["doc_id"])
    own = F.col("own")
    values = {"{h}": F.col("doc_id").cast("string"), "{f}": (F.col("doc_id") + 6).cast("string"), "{p}": F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")), "{s}": own, "{b}": (F.col("doc_id") % 7).cast("string")}
    text = ending = F.lit(None).cast("string")
    for k, (end, template) in enumerate(FILES):
        filled = F.lit(template.replace("{{", "\x01").replace("}}", "\x02"))
        for name, value in values.items():
            filled = F.replace(filled, F.lit(name), value)
        filled = F.translate(filled, "\x01\x02", "{}")
        text, ending = F.when(F.col("doc_id") % 6 == k, filled).otherwise(text), F.when(F.col("doc_id") % 6 == k, end).otherwise(ending)
    made = docs.select("doc_id", "own", text.alias("text"), ending.alias("ending"))
    path = F.concat(F.lit(f"{ROOT}/"), "own", F.lit("/d"), F.col("doc_id").cast("string"), F.lit("."), "ending")
    return made.select(path.alias("path"), F.encode("text", "utf-8").alias("content"), F.octet_length("text").cast("long").alias("length"), F.lit(0).cast("long").alias("mtime_ns"))
