"""Node tables of marked-up pages: one row for every element, in the order of the opening tags."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package

# Elements without content, and elements whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = ("script", "style")
TAG = re.compile(r"<!--.*?-->|" + "|".join(rf"<{r}\b[^<>]*>.*?</{r}\s*>" for r in RAW) + r"|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>([^<]*)", re.S | re.I)
ROWS = 20_000
_SCHEMA = pa.schema([("tree", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("node_type", pa.string()), ("attrs", pa.string()), ("text", pa.string())])


def elements(page: str) -> list[tuple[int, int, str, str, str]]:
    """(start, stop, type, attributes, text up to the next tag) of the elements, numbered by tags as written; see ``nodes``."""
    out, open_, at = [], [], 0
    for m in TAG.finditer(page):
        if m[2] is None:
            if not m[0].startswith("<!--"):
                name, rest = re.match(r"<(\w+)([^<>]*)", m[0]).groups()
                out.append([at, at + 1, name.lower(), rest.strip(), ""])
                at += 1
            continue
        name, rest, k = m[2].lower(), m[3], at
        at += 1
        if not m[1]:
            alone = name in VOID or rest.endswith("/")
            out.append([k, k + 1, name, rest.removesuffix("/").strip(), m[4]])
            if not alone:
                open_.append(len(out) - 1)
        elif any(out[i][2] == name for i in open_):
            while open_:
                done = open_.pop()
                out[done][1] = k
                if out[done][2] == name:
                    break
    for i in open_:
        out[i][1] = at
    return out


def nodes(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id_col, tree, start, stop, node_type, attrs, text): the elements of every page.

    ``tree`` numbers the pages, so that pages of one id stay apart. ``start`` is the number of the opening tag among the page's tags, and
    [start, stop) holds those of all elements within. Tags count as they are written: a closing tag ends the innermost open element of its name and what is
    open within that; one that closes nothing is passed over; what is never closed reaches to the end. Types are in lower case; ``text`` is
    what stands between the opening tag and the next tag. Comments are no nodes; scripts and styles have no text. Null and empty pages have no rows.

    A page's rows are made in one task and stay together in order, so ``trees.match`` needs no shuffle for them.
    """
    ship_package(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("tree"), F.col(html_col).alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, trees, found = [], [], []
            for k, page in enumerate(b.column(2)):
                mine = elements(page.as_py() or "")
                found += mine
                ids += [k] * len(mine)
                trees += [b.column(1)[k].as_py()] * len(mine)
                if len(found) >= ROWS or (k + 1 == b.num_rows and found):
                    parts = [trees, *(list(c) for c in zip(*found))]
                    columns = [pa.array(c, f.type) for c, f in zip(parts, _SCHEMA)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids)), *columns], ["id", *_SCHEMA.names])
                    ids, trees, found = [], [], []

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, tree long, start int, stop int, node_type string, attrs string, text string")
    return out.withColumnRenamed("id", id_col)
