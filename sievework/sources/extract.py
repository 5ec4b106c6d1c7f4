"""From ``files`` to the base relations: symbols, call_edges, imports, inherits, lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import sanitize
from ..operators.pattern import lines_of
from ..semantics import DEFAULT, Semantics
from ..session import stored
from ..shipping import ship_package

RECORDS = "rec string, seq int, grammar_kind string, name string, receiver string, start_row int, end_row int, callee_name string, import_path string, parent_name string, first boolean, doc string"
# Grammar kinds and what they are; others count as functions.
KINDS = {
    "function_declaration": ("FUNCTION", "fn", "Function"),
    "method_declaration": ("METHOD", "meth", "Method"),
    "module": ("MODULE", "module", "Symbol"),
    "module_declaration": ("MODULE", "module", "Symbol"),
} | {f"{k}_declaration": ("CLASS", "class", "Class") for k in "type class interface type_alias enum struct trait".split()}


#: Records, and characters of text, that a task puts into one batch.
BATCH_RECORDS, BATCH_CHARS = 5_000, 4_000_000


def records(files: DataFrame) -> DataFrame:
    """One tagged row per symbol, call, import and parent, with its file's package and language, and ``doc`` of symbols.

    Each file is looked at once: its text goes through Python in Arrow batches and and the list of its records comes back, so that nothing is joined to files again.
    Records are put together by column; the text stays in Python, where ``doc`` is found too.
    """
    ship_package(files.sparkSession)
    own = StructType.fromDDL("path string, pkg string, lang string")
    found = StructType.fromDDL(f"found array<struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in StructType.fromDDL(RECORDS))}>>")
    schema = to_arrow_schema(StructType(own.fields + found.fields))
    kind = schema.field("found").type
    names = [f.name for f in kind.value_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sievework.sources.lexers import doc_above, extract

        def made(b: pa.RecordBatch, ends: list[int], columns: list[list]) -> pa.RecordBatch:
            each = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind.value_type)], fields=list(kind.value_type))
            return pa.RecordBatch.from_arrays([b[n].cast(schema.field(n).type) for n in own.fieldNames()] + [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each, type=kind)], schema=schema)

        for b in batches:
            texts, langs = b["text"], b["lang"]
            start, chars, ends, columns = 0, 0, [0], [[] for _ in names]
            for n in range(b.num_rows):
                text = texts[n].as_py() or ""
                lines = text.split("\n") if "//" in text else []
                for r in extract(text, langs[n].as_py()):
                    if r["rec"] == "symbol":
                        r["doc"] = doc_above(lines, r["start_row"])
                    for c, name in zip(columns, names):
                        c.append(r.get(name))
                ends.append(len(columns[0]))
                chars += len(text)
                if ends[-1] >= BATCH_RECORDS or chars >= BATCH_CHARS or n + 1 == b.num_rows:
                    yield made(b.slice(start, n + 1 - start), ends, columns)
                    start, chars, ends, columns = n + 1, 0, [0], [[] for _ in names]

    return files.select(*own.fieldNames(), "text").mapInArrow(run, StructType(own.fields + found.fields)).select(*own.fieldNames(), F.inline("found"))


def base_relations(files: DataFrame, semantics: Semantics = DEFAULT, cache: bool = True, store: bool = False) -> dict[str, DataFrame]:
    """All base relations of ``files``. Every relation reads the records: they are cached, or, with ``store``, written once as a table in the shared folder
    (see ``session.stored``), so that a plan that names relations many times extracts once and holds nothing in memory."""
    rec = records(files)
    if store:
        rec = stored(rec, "records")
    elif cache:
        rec = rec.persist()
    kind = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[0])])
    id_kind = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[1])])
    s = rec.where("rec = 'symbol'")
    s = s.withColumns({"kind": F.coalesce(F.element_at(kind, F.col("grammar_kind")), F.lit("FUNCTION")), "id_kind": F.coalesce(F.element_at(id_kind, F.col("grammar_kind")), F.lit("fn"))})
    s = s.withColumn("id_kind", F.when((F.col("id_kind") == "meth") & (F.col("receiver") == ""), "fn").otherwise(F.col("id_kind")))
    part = lambda c: F.when(F.col(c) != "", F.col(c))
    body = lambda recv: F.concat_ws(".", part("pkg"), recv, part("name"))
    symbol_id = F.concat(F.col("id_kind"), F.lit(":"), body(part("receiver")))
    label = F.when(F.col("kind") == "FUNCTION", "Function").when(F.col("kind") == "METHOD", "Method").when(F.col("kind") == "CLASS", "Class").otherwise("Symbol")
    symbols = s.select("path", "pkg", "lang", "seq", "grammar_kind", "kind", "id_kind", "name", "receiver", "start_row", "end_row", symbol_id.alias("id"), F.concat(label, F.lit(": "), sanitize(F.col("name"))).alias("summary"), "doc")
    c = rec.where("rec = 'call'").withColumn("id_kind", F.when(F.col("receiver") != "", "meth").otherwise("fn"))
    calls = c.select("path", "pkg", symbol_id.alias("caller_id"), F.col("name").alias("caller_name"), F.col("receiver").alias("caller_receiver"), F.col("start_row").alias("caller_start_row"), "callee_name", F.col("end_row").alias("row"))
    sites = calls
    # package and id follow from the others; with them, what asks for a caller asks before calls are dealt out, and rows need no sorting
    calls = calls.drop("row").dropDuplicates()
    i = rec.where("rec = 'import'")
    if not semantics.all_imports:
        i = i.where("first")
    imports = i.select("path", "import_path", "start_row", "end_row").dropDuplicates(["path", "import_path"])
    inherits = rec.where("rec = 'inherits'").select("path", F.col("name").alias("class_name"), "parent_name").distinct()
    return {"files": files, "lines": lines_of(files, ["path"], "text"), "symbols": symbols, "call_edges": calls, "call_sites": sites, "imports": imports, "inherits": inherits}


def token_rows(files: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """(path, row, place, token): words, numbers and strings outside comments, in order; with ``ranges`` (path, start, end) of these rows."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sievework.sources.lexers import tokens

        for b in batches:
            for p, t, lang in zip(*(c.to_pylist() for c in b.columns)):
                got = tokens(t or "", lang)
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(got), pa.string()), pa.array([r for r, _ in got], pa.int32()), pa.array(range(len(got)), pa.int32()), pa.array([x for _, x in got], pa.string())], ["path", "row", "place", "token"])

    rows = files.select("path", "text", "lang").mapInArrow(run, "path string, row int, place int, token string")
    if ranges is None:
        return rows
    r = ranges.select(F.col("path").alias("__p"), F.col("start").alias("__a"), F.col("end").alias("__b"))
    return rows.join(r, (F.col("path") == F.col("__p")) & (F.col("row") >= F.col("__a")) & (F.col("row") < F.col("__b")), "left_semi")


def resolve_receivers(symbols: DataFrame) -> DataFrame:
    """(id, path, seq, receiver_id): a method's class, of its package if there is one, else the first of that name."""
    from pyspark.sql import Window as W

    m = symbols.where("receiver <> ''").select("id", "path", "seq", "pkg", "receiver")
    c = symbols.where("kind = 'CLASS'").select(F.col("name").alias("receiver"), F.col("pkg").alias("cp"), F.col("path").alias("cpath"), F.col("seq").alias("cseq"), F.col("id").alias("receiver_id"))
    w = W.partitionBy("id", "path", "seq").orderBy(F.when(F.col("cp") == F.col("pkg"), 0).otherwise(1), "cpath", "cseq")
    return m.join(c, "receiver", "left").withColumn("k", F.row_number().over(w)).where("k = 1").select("id", "path", "seq", "receiver_id")


def replace_file(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Base relations in which all rows of the files in ``new`` are replaced."""
    paths = new["files"].select("path").distinct()
    return {k: old[k].join(paths, "path", "left_anti").unionByName(new[k]) for k in old}
