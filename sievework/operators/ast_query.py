"""Patterns over declarations and calls, in a subset of S-expression queries.

    (function_declaration name: (identifier) @name)
    (method_declaration name: (field_identifier) @m receiver: (_) @r)
    (call_expression function: (identifier) @callee)
    (class_declaration) @whole

Node types are the grammar kinds of ``symbols``, and call_expression; fields are name, receiver and function. Predicates
``(#eq? @a "text")``, ``(#not-eq? ...)`` and ``(#match? @a "regex")`` filter. Each capture of a match is a row. Patterns that nest nodes

    (type_declaration (method_declaration ..(call_expression) @call (#eq? @call "close")) @method)

follow ``trees``: a captured node comes once for each name. Anything else raises ValueError.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MAX_PATTERN_BYTES, java_pattern
from . import trees

_TOKEN = re.compile(r'\s*([()]|"(?:\\.|[^"\\])*"|@[\w.-]+|#[\w-]+\??|\w+:|\w+)')
#: A node within a node: alternatives, ``..``, or a second type that is no field's.
NESTED = re.compile(r"\.\.|\[\s*\(|\(\w+[^()]*(?<!:)(?<!:\s)\(\w")
FIELDS = {"name": "name", "receiver": "receiver", "function": "callee_name"}


def _parse(text: str) -> list:
    stack, at = [[]], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"bad pattern at {text[at:at + 20]!r}")
        at, t = m.end(), m[1]
        if t == "(":
            stack.append([])
        elif t == ")":
            if len(stack) < 2:
                raise ValueError("an unmatched bracket")
            done = stack.pop()
            stack[-1].append(done)
        else:
            stack[-1].append(t)
    if len(stack) != 1:
        raise ValueError("an open bracket")
    return stack[0]


def query(symbols: DataFrame, calls: DataFrame, pattern: str) -> DataFrame:
    """(path, start_row, end_row, node_type, capture, text) of every capture. ``calls`` are call sites: every call with its ``row``."""
    if len(pattern.encode()) > MAX_PATTERN_BYTES:
        raise ValueError(f"a pattern has at most {MAX_PATTERN_BYTES} bytes")
    if NESTED.search(pattern):
        found = trees.match(trees.code_nodes(symbols, calls), pattern)
        return found.select("path", F.col("start").alias("start_row"), F.col("stop").alias("end_row"), "node_type", "capture", "text").orderBy("path", "start_row", "capture")
    parts = _parse(pattern)
    heads = [p for p in parts if isinstance(p, list) and p and not (isinstance(p[0], str) and p[0].startswith("#"))]
    if len(heads) != 1:
        raise ValueError("one node pattern is supported")
    head, outer = heads[0], [p for p in parts if isinstance(p, str)]
    kind, captures, k, inner = head[0], {}, 1, []
    if isinstance(kind, list):
        raise ValueError("grouped patterns are not supported")
    while k < len(head):
        item = head[k]
        if isinstance(item, str) and item.endswith(":"):
            field = item[:-1]
            if field not in FIELDS or k + 1 >= len(head) or not isinstance(head[k + 1], list):
                raise ValueError(f"unsupported field {item}")
            k += 2
            if k < len(head) and isinstance(head[k], str) and head[k].startswith("@"):
                captures[head[k]] = FIELDS[field]
                k += 1
        elif isinstance(item, list) and item and isinstance(item[0], str) and item[0].startswith("#"):
            inner.append(item)
            k += 1
        elif isinstance(item, str) and item.startswith("@"):
            outer.append(item)
            k += 1
        else:
            raise ValueError(f"unsupported part {item!r}")
    for c in outer:
        if not c.startswith("@"):
            raise ValueError(f"unsupported part {c!r}")
        captures[c] = None
    if kind == "call_expression":
        rows = calls.select("path", F.col("row").alias("start_row"), (F.col("row") + 1).alias("end_row"), "callee_name", F.lit("").alias("name"), F.lit("").alias("receiver"))
    else:
        rows = symbols.where(F.col("grammar_kind") == kind).select("path", "start_row", "end_row", F.lit("").alias("callee_name"), "name", "receiver")
    for p in inner + [p for p in parts if isinstance(p, list) and p and isinstance(p[0], str) and p[0].startswith("#")]:
        op, cap, value = p[0], p[1], p[2].strip('"').replace('\\"', '"').replace("\\\\", "\\")
        col: Column = F.col(captures.get(cap) or "name")
        test = {"#eq?": lambda: col == value, "#not-eq?": lambda: col != value, "#match?": lambda: col.rlike(java_pattern(value))}.get(op)
        if test is None:
            raise ValueError(f"unsupported predicate {op}")
        rows = rows.where(test())
    out = None
    for cap, field in captures.items():
        one = rows.select("path", "start_row", "end_row", F.lit(kind).alias("node_type"), F.lit(cap[1:]).alias("capture"), (F.col(field) if field else F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("callee_name"))).alias("text"))
        out = one if out is None else out.unionAll(one)
    if out is None:
        raise ValueError("a pattern needs a capture")
    return out.orderBy("path", "start_row", "capture")
