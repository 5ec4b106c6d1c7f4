"""Nested patterns over trees: which nodes take part in a match of a pattern with children, descendants, alternatives and predicates.

    (class_declaration (method_declaration ..(call_expression) @call) @method)
    (ul (li (a) @first) (li (a) @second))
    (article (h1) @title ..[(p) (li)] @block (#match? @block.attrs "lead"))

A node pattern is ``(type items)``; ``_`` is any type, ``[...]`` holds alternatives, ``field:`` before a pattern asks for that value in the column ``field``.
Items are child patterns, which must match different children in the order given (others may stand between), and patterns of descendants, after ``..``,
at any depth in any order. ``@name`` after a pattern captures its nodes. Predicates ``#eq?``, ``#not-eq?``, ``#match?``, ``#not-match?`` and ``#any-of?`` test a capture's
column (``text``, or the one after a dot) and may stand in any brackets. Anything else raises ValueError.

The result has each captured node once for each name, however many matches it takes part in: there are as many rows as nodes at most, where pairs of
siblings or of ancestors and descendants would grow with the square. It comes from two passes over the pattern. Bottom up, a node satisfies a pattern if its
type and predicates hold, the ordered children are found (the earliest place for each, and the latest), and the range of its descendants, which are
consecutive in document order, has one for each descendant pattern, by differences of running counts. Top down, what lies below bound nodes is bound.

Nodes are rows (tree, start, stop) of nested spans, sorted once by tree, start and falling stop; a stack turns spans into parents and ranges. Whole trees are judged in
blocks of some ``ROWS`` nodes, vectorised; a task holds a block, or one tree if that is larger. A span that ends beyond the one it begins in is
cut off there. Rows without tree, start or stop are left out; of equal spans the one with the smaller ``level`` (a column that may be there) is outside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import MAX_PATTERN_BYTES, java_pattern
from ..shipping import ship_package

ROWS = 50_000
_TOKEN = re.compile(r'\s*(\.\.|[()\[\]]|"(?:\\.|[^"\\])*"|@[\w.-]+|#[\w-]+\?|\w+:|\w+)')
PREDICATES = ("#eq?", "#not-eq?", "#match?", "#not-match?", "#any-of?")


@dataclass
class Node:
    type: str | None = None
    options: list[Node] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)
    below: list[Node] = field(default_factory=list)
    captures: list[str] = field(default_factory=list)
    field: str | None = None

    def all(self) -> Iterator[Node]:
        yield self
        for x in self.options + self.children + self.below:
            yield from x.all()


@dataclass
class Pattern:
    root: Node
    #: (predicate, capture, column, values)
    tests: list[tuple[str, str, str, list[str]]]

    @property
    def captures(self) -> list[str]:
        return list(dict.fromkeys(c for n in self.root.all() for c in n.captures))


class _Reader:
    """Reads a pattern's tokens from left to right."""

    def __init__(self, text: str):
        self.tokens, self.at, self.tests = [], 0, []
        at = 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"bad pattern at {text[at : at + 20]!r}")
            at = m.end()
            self.tokens.append(m[1])

    def peek(self, further: int = 0) -> str:
        return self.tokens[self.at + further] if self.at + further < len(self.tokens) else ""

    def take(self, want: str = "") -> str:
        t = self.peek()
        if not t or (want and t != want):
            raise ValueError(f"{want or 'more'} expected, not {t!r}")
        self.at += 1
        return t

    def test(self) -> None:
        self.take("(")
        op, what, values = self.take(), self.take(), []
        if op not in PREDICATES or not what.startswith("@"):
            raise ValueError(f"unsupported predicate {op}")
        while self.peek() != ")":
            v = self.take()
            if not v.startswith('"'):
                raise ValueError("a predicate compares a capture with texts")
            # in regular expressions only quotes and backslashes are escaped
            values.append(re.sub(r'\\(["\\])' if "match" in op else r"\\(.)", r"\1", v[1:-1]))
        self.take(")")
        if not values or (op != "#any-of?" and len(values) > 1):
            raise ValueError(f"{op} has one text")
        name, _, column = what[1:].partition(".")
        self.tests.append((op, name, column or "text", values))

    def node(self) -> Node:
        out = Node()
        if self.peek() == "[":
            self.take()
            while self.peek() != "]":
                out.options.append(self.node())
            self.take()
            if not out.options:
                raise ValueError("no alternatives")
        else:
            self.take("(")
            out.type = self.take()
            if not re.fullmatch(r"\w+", out.type):
                raise ValueError(f"a type expected, not {out.type!r}")
            while self.peek() != ")":
                self.item(out)
            self.take()
        while self.peek().startswith("@"):
            out.captures.append(self.take()[1:])
        return out

    def item(self, out: Node) -> None:
        if self.peek() == "(" and self.peek(1).startswith("#"):
            self.test()
        elif self.peek() == "..":
            self.take()
            out.below.append(self.node())
        else:
            named = self.take()[:-1] if re.fullmatch(r"\w+:", self.peek()) else None
            out.children.append(self.node())
            out.children[-1].field = named


def parse(text: str) -> Pattern:
    if len(text.encode()) > MAX_PATTERN_BYTES:
        raise ValueError(f"a pattern has at most {MAX_PATTERN_BYTES} bytes")
    reader = _Reader(text)
    root = reader.node()
    while reader.peek():
        reader.test()
    made = Pattern(root, reader.tests)
    if not made.captures:
        raise ValueError("a pattern needs a capture")
    for _, name, _, _ in made.tests:
        if name not in made.captures:
            raise ValueError(f"no capture @{name}")
    return made


class Forest:
    """A block of whole trees in document order: parents, and ``end``, the place behind the last descendant."""

    def __init__(self, tree: np.ndarray, start: np.ndarray, stop: np.ndarray):
        n = len(start)
        self.n, self.parent, self.end = n, np.full(n, n), np.empty(n, np.int64)
        stack, stops = [], []
        last = None
        for i, (t, a, z) in enumerate(zip(tree.tolist(), start.tolist(), stop.tolist())):
            if t != last:
                self.end[stack] = i
                stack, stops, last = [], [], t
            while stack and stops[-1] <= a:
                self.end[stack.pop()] = i
                stops.pop()
            if stack:
                self.parent[i] = stack[-1]
                z = min(z, stops[-1])
            stack.append(i)
            stops.append(z)
        self.end[stack] = n

    def runs(self, oks: list[np.ndarray], backwards: bool = False) -> list[np.ndarray]:
        """For each parent and k, the earliest place at which children with ok 1 to k are found in order (n if they are not); backwards, the
        latest place at which the last k are found (-1 if they are not). The extra parent n holds the roots."""
        none = -1 if backwards else self.n
        out = [np.full(self.n + 1, self.n if backwards else -1)]
        for ok in reversed(oks) if backwards else oks:
            v = np.flatnonzero(ok)
            p = self.parent[v]
            good = (v < out[-1][p]) if backwards else (v > out[-1][p])
            best = np.full(self.n + 1, none)
            (np.maximum if backwards else np.minimum).at(best, p[good], v[good])
            out.append(best)
        return out

    def holds(self, ok: np.ndarray) -> np.ndarray:
        """Whether a node has a descendant that is ok."""
        upto = np.concatenate([[0], np.cumsum(ok)])
        return upto[self.end] > upto[np.arange(self.n) + 1]

    def within(self, bound: np.ndarray) -> np.ndarray:
        """Whether a node is a descendant of a bound one."""
        step = np.zeros(self.n + 1, np.int64)
        step[np.flatnonzero(bound) + 1] += 1
        np.subtract.at(step, self.end[bound], 1)
        return np.cumsum(step)[: self.n] > 0


def bind(pattern: Pattern, forest: Forest, types: pa.Array, tested: dict[str, np.ndarray], fields: pa.Array | None) -> dict[str, np.ndarray]:
    """For every capture, which nodes it binds. ``tested`` has the outcome of each capture's predicates for all nodes."""
    everything = np.ones(forest.n, bool)
    sat: dict[int, np.ndarray] = {}

    def is_(column: pa.Array, value: str) -> np.ndarray:
        return pc.fill_null(pc.equal(column, value), False).to_numpy(zero_copy_only=False)

    def up(q: Node) -> np.ndarray:
        if q.options:
            ok = reduce(np.logical_or, [up(o) for o in q.options])
        else:
            ok = everything if q.type == "_" else is_(types, q.type)
        for name in q.captures:
            ok = ok & tested.get(name, everything)
        if q.field:
            ok = ok & is_(fields, q.field)
        if q.children:
            ok = ok & (forest.runs([up(c) for c in q.children])[-1][: forest.n] < forest.n)
        for d in q.below:
            ok = ok & forest.holds(up(d))
        sat[id(q)] = ok
        return ok

    out: dict[str, np.ndarray] = {}

    def down(q: Node, bound: np.ndarray) -> None:
        for name in q.captures:
            out[name] = out[name] | bound if name in out else bound
        for o in q.options:
            down(o, bound & sat[id(o)])
        oks = [sat[id(c)] for c in q.children]
        first, last = (forest.runs(oks, way) for way in (False, True)) if oks else ((), ())
        held = np.append(bound, False)[forest.parent]
        places = np.arange(forest.n)
        for k, c in enumerate(q.children):
            down(c, oks[k] & held & (places > first[k][forest.parent]) & (places < last[len(oks) - k - 1][forest.parent]))
        for d in q.below:
            down(d, sat[id(d)] & forest.within(bound))

    down(pattern.root, up(pattern.root))
    return out


def match(nodes: DataFrame, pattern: str, in_order: bool = False) -> DataFrame:
    """The rows of ``nodes`` that the pattern captures, each with ``capture`` string; see ``match_all``."""
    return match_all(nodes, {"": pattern}, in_order).drop("pattern")


def match_all(nodes: DataFrame, patterns: dict[str, str], in_order: bool = False) -> DataFrame:
    """The rows of ``nodes`` that patterns capture, each with ``pattern`` (its key) and ``capture``; all patterns are judged in one pass.

    ``in_order``: the rows of each tree already stand together, sorted, in one partition (as ``markup.nodes`` leaves them). Otherwise they are dealt
    out by tree and sorted once.
    """
    made = {name: parse(text) for name, text in patterns.items()}
    columns = nodes.columns
    with_field = any(n.field for m in made.values() for n in m.root.all())
    for need in ["tree", "start", "stop", "node_type", *(t[2] for m in made.values() for t in m.tests), *["field"] * with_field]:
        if need not in columns:
            raise ValueError(f"nodes have no column {need}")
    ship_package(nodes.sparkSession)
    rows = nodes.where("tree IS NOT NULL AND start IS NOT NULL AND stop IS NOT NULL")
    # predicates are evaluated by Spark, as one column for each capture
    outcome: dict[tuple[str, str], list] = {}
    for key, m in made.items():
        for op, name, column, values in m.tests:
            c = F.col(f"`{column}`")
            ok = c.isin(values) if op == "#any-of?" else c == values[0] if op.endswith("eq?") else c.rlike(java_pattern(values[0]))
            outcome.setdefault((key, name), []).append(F.coalesce(~ok if "not-" in op else ok, F.lit(False)))
    places = {at: f"__ok{k}" for k, at in enumerate(outcome)}
    rows = rows.select("*", *[reduce(lambda a, b: a & b, outcome[at]).alias(c) for at, c in places.items()])
    if not in_order:
        level = [F.col("level")] if "level" in columns else []
        rows = rows.repartition("tree").sortWithinPartitions("tree", "start", F.desc("stop"), *level)

    def judge(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        one = lambda c: t[c].chunk(0)
        forest = Forest(*(one(c).to_numpy(zero_copy_only=False) for c in ("tree", "start", "stop")))
        for key, m in made.items():
            tested = {name: one(c).to_numpy(zero_copy_only=False) for (k, name), c in places.items() if k == key}
            found = bind(m, forest, one("node_type"), tested, one("field") if with_field else None)
            for name in m.captures:
                hit = t.select(columns).take(pa.array(np.flatnonzero(found[name])))
                for c, value in (("pattern", key), ("capture", name)):
                    hit = hit.append_column(c, pa.array([value] * hit.num_rows, pa.string()))
                yield from hit.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size < ROWS:
                continue
            trees = b.column(b.schema.get_field_index("tree")).to_numpy(zero_copy_only=False)
            whole = int(np.argmax(trees[::-1] != trees[-1])) or len(trees)  # rows of the last tree
            if whole < len(trees):  # what comes before it is complete
                yield from judge(pa.Table.from_batches([*held[:-1], b.slice(0, len(trees) - whole)]))
                held, size = [b.slice(len(trees) - whole)], whole
            elif len(held) > 1 and held[-2].column(held[-2].schema.get_field_index("tree"))[-1].as_py() != trees[0]:
                yield from judge(pa.Table.from_batches(held[:-1]))
                held, size = [b], b.num_rows
        if held:
            yield from judge(pa.Table.from_batches(held))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, pattern string, capture string")


def code_nodes(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """Nodes of source files: declarations by their rows, and call sites within them; ``path`` is hashed to ``tree``. Text is the name, or what is called."""
    tree = F.xxhash64("path").alias("tree")
    s = symbols.select("path", tree, F.col("start_row").alias("start"), F.col("end_row").alias("stop"), F.lit(0).alias("level"), F.col("grammar_kind").alias("node_type"), F.col("name").alias("text"), "receiver")
    c = calls.select("path", tree, F.col("row").alias("start"), (F.col("row") + 1).alias("stop"), F.lit(1).alias("level"), F.lit("call_expression").alias("node_type"), F.col("callee_name").alias("text"), F.lit("").alias("receiver"))
    return s.unionAll(c)
