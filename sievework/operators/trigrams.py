"""Regular-expression search through a stored index of trigrams: only files that can hold a match are searched.

The index has two tables: the files, numbered, and for each trigram (three bytes of UTF-8) the numbers of the files that have it. Each task writes its own
files' postings, sorted by trigram, so building needs no shuffle and no trigram is hot; a search reads the pages that hold its trigrams.

From a pattern follows which trigrams a matching line must have: sequences of characters and small classes are spelled out, alternatives are joined by
"or", what follows each other by "and"; whatever may be anything asks for nothing. Of trigrams joined by "and" the ``RAREST`` are looked up. Files that pass are
then searched with the pattern itself, so the answer is that of a full search. Where nothing is required (patterns without three characters in a row, ignored
case, classes within classes), or the rarest trigrams are in more than ``MOST`` of the files, all files are searched.

Defined results: null and empty texts have no trigrams and no lines; files of the same path stay apart; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import java_pattern, path_passes_glob
from ..session import new_path
from ..shipping import ship_package
from .pattern import find_lines, lines_of

HELD = 4_000_000
LONG = 1 << 20
RAREST, MOST = 3, 0.5
CLASS, STRINGS = 16, 48
BROADCAST_FILES = 1_000_000

# what must be there: True (nothing), a trigram's number, or ("and" | "or", (needs, ...))
Need = bool | int | tuple


def _join(op: str, needs: list[Need]) -> Need:
    flat: list[Need] = []
    for n in needs:
        flat += n[1] if isinstance(n, tuple) and n[0] == op else [n]
    if op == "or" and True in [n for n in flat if n is True]:
        return True
    flat = list(dict.fromkeys(n for n in flat if n is not True))
    return True if not flat else flat[0] if len(flat) == 1 else (op, tuple(flat))


def _grams(text: bytes) -> Need:
    return _join("and", [int.from_bytes(text[k : k + 3], "big") for k in range(len(text) - 2)])


class _Run:
    """The texts that the pattern's latest part can be, and what the parts before them need."""

    def __init__(self):
        self.texts, self.needs, self.exact = {b""}, [], True

    def spell(self) -> None:
        self.needs.append(_join("or", [_grams(t) for t in sorted(self.texts)]))

    def add(self, texts: set[bytes]) -> None:
        if len(self.texts) * len(texts) > STRINGS:  # the last two bytes go on into what follows
            self.spell()
            self.texts, self.exact = {t[-2:] for t in self.texts}, False
            if len(self.texts) * len(texts) > STRINGS:
                self.texts = {b""}
        self.texts = {a + b for a in self.texts for b in texts}

    def stop(self, need: Need = True, then: set[bytes] | None = None) -> None:
        """Anything may stand here; what follows begins with ``then``."""
        self.spell()
        self.needs.append(need)
        self.texts, self.exact = then or {b""}, False

    def need(self) -> Need:
        return _join("and", [*self.needs, _join("or", [_grams(t) for t in sorted(self.texts)])])


def _class(items: list) -> set[bytes] | None:
    out: set[bytes] = set()
    for op, value in items:
        if op is sre.LITERAL:
            out.add(chr(value).encode("utf-8", "surrogatepass"))
        elif op is sre.RANGE and value[1] - value[0] < CLASS:
            out |= {chr(c).encode("utf-8", "surrogatepass") for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= CLASS else None


def _read(parsed, run: _Run) -> _Run:
    for op, value in parsed:
        if op is sre.LITERAL:
            run.add({chr(value).encode("utf-8", "surrogatepass")})
        elif op is sre.IN and (chars := _class(value)):
            run.add(chars)
        elif op is sre.AT:
            continue
        elif op is sre.SUBPATTERN and not (value[1] | value[2]) & re.IGNORECASE:
            _read(value[3], run)
        elif op is sre.BRANCH:
            ways = [_read(p, _Run()) for p in value[1]]
            if all(w.exact for w in ways) and sum(len(w.texts) for w in ways) <= STRINGS:
                run.add(set().union(*(w.texts for w in ways)))
            else:
                run.stop(_join("or", [w.need() for w in ways]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0] + value[1] == 1:
            once = _read(value[2], _Run())
            run.add(once.texts | {b""}) if once.exact else run.stop()
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and value[0]:
            once = _read(value[2], _Run())
            if once.exact:
                for _ in range(min(value[0], 8)):
                    run.add(once.texts)
                if not value[0] == value[1] <= 8:
                    run.stop(then=once.texts)  # the last one may come much later
            else:
                run.stop(once.need())
        else:
            run.stop()
    return run


def required(pattern: str) -> Need:
    """What a line must have to match. Raises ValueError for a bad pattern."""
    text = java_pattern(pattern)
    if re.search(r"\[\^?\]?(?:\\.|[^\]\\])*?(?:\[|&&)", re.sub(r"\\[^\[\]&]", "..", pattern)):
        return True  # classes within classes
    try:
        parsed = _parser.parse(re.sub(r"\\[pP](?:\{\w+\}|\w)", r"\\w", text).replace("(?<", "(?P<").replace(r"\z", r"\Z"))
    except (re.error, RecursionError):
        return True
    return True if parsed.state.flags & re.IGNORECASE else _read(parsed, _Run()).need()


def trigrams_of(need: Need) -> set[int]:
    return {need} if need is not True and isinstance(need, int) else set().union(*map(trigrams_of, need[1])) if isinstance(need, tuple) else set()


def rarest(need: Need, counts: dict[int, int]) -> Need:
    """Of each "and", the ``RAREST`` single trigrams and all that is no single trigram."""
    if not isinstance(need, tuple):
        return need
    inner = [rarest(n, counts) for n in need[1]]
    if need[0] == "and":
        single = sorted((n for n in inner if not isinstance(n, tuple)), key=lambda n: (counts.get(n, 0), n))
        inner = single[:RAREST] + [n for n in inner if isinstance(n, tuple)]
    return _join(need[0], inner)


def at_most(need: Need, counts: dict[int, int], n: int) -> int:
    """A bound on the number of files that pass."""
    if need is True:
        return n
    if not isinstance(need, tuple):
        return counts.get(need, 0)
    parts = [at_most(x, counts, n) for x in need[1]]
    return min(parts) if need[0] == "and" else min(n, sum(parts))


def _passes(need: Need, have: Column) -> Column:
    if not isinstance(need, tuple):
        return F.array_contains(have, need)
    parts = [_passes(x, have) for x in need[1]]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if need[0] == "and" else (out | p)
    return out


def distinct_trigrams(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) < 3:
        return np.empty(0, np.int64)
    if len(data) <= LONG:
        d = data.astype(np.int32)
        return np.unique(d[:-2] << 16 | d[1:-1] << 8 | d[2:]).astype(np.int64)
    seen = np.zeros(1 << 24, bool)
    for at in range(0, len(data) - 2, LONG):
        d = data[at : at + LONG + 2].astype(np.int32)
        seen[d[:-2] << 16 | d[1:-1] << 8 | d[2:]] = True
    return np.flatnonzero(seen)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(trigram, block, files): the files of a block that have a trigram, by their distance from the block's first."""
    held: list[np.ndarray] = []
    size, first = 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        keys = np.sort(np.concatenate(held))
        grams, at = np.unique(keys >> 32, return_index=True)
        files = pa.array((keys & 0xFFFFFFFF).astype(np.int32))
        ends = np.append(at, len(keys)).astype(np.int32)
        for k in range(0, len(grams), 20_000):
            part = ends[k : k + 20_001]
            lists = pa.ListArray.from_arrays(pa.array(part - part[0]), files[part[0] : part[-1]])
            yield pa.RecordBatch.from_arrays([pa.array(grams[k : k + 20_000].astype(np.int32)), pa.array(np.full(len(part) - 1, first)), lists], ["trigram", "block", "files"])

    for b in batches:
        for no, text in zip(b.column(0).to_pylist(), b.column(1)):
            found = distinct_trigrams(text.as_py() or "")
            if held and (size + len(found) > HELD or not 0 <= no - first < 1 << 31):
                yield from flush()
                held, size = [], 0
            if not held:
                first = no
            if len(found):
                held.append(found << 32 | (no - first))
                size += len(found)
    if held:
        yield from flush()


class TrigramIndex:
    """A stored index; ``files`` has the columns of the indexed table and ``no``."""

    def __init__(self, spark: SparkSession, folder: str, text_col: str = "text"):
        self.folder, self.text_col = folder, text_col
        self.files = spark.read.parquet(f"{folder}/files")
        self.postings = spark.read.schema("trigram int, block long, files array<int>").parquet(f"{folder}/postings")

    @classmethod
    def build(cls, files: DataFrame, text_col: str = "text", folder: str | None = None) -> TrigramIndex:
        """Index a table; without ``folder`` in the shared one."""
        spark = files.sparkSession
        ship_package(spark)
        folder = folder or new_path(spark, "trigrams")
        files.withColumn("no", F.monotonically_increasing_id()).write.parquet(f"{folder}/files")
        found = spark.read.parquet(f"{folder}/files").select("no", text_col).mapInArrow(_postings, "trigram int, block long, files array<int>")
        found.sortWithinPartitions("trigram").write.parquet(f"{folder}/postings")
        return cls(spark, folder, text_col)

    def candidates(self, pattern: str) -> DataFrame | None:
        """(no) of the files to be searched; None: all of them."""
        need = required(pattern)
        if need is True:
            return None
        wanted = self.postings.where(F.col("trigram").isin(sorted(trigrams_of(need))))
        counts = dict(wanted.groupBy("trigram").agg(F.sum(F.size("files")).cast("long")).collect())  # a row for each trigram of the pattern at most
        need, n = rarest(need, counts), self.files.count()
        if at_most(need, counts, n) > MOST * n:
            return None
        few = wanted.where(F.col("trigram").isin(sorted(trigrams_of(need))))
        each = few.select("trigram", "block", F.explode("files").alias("further")).select("trigram", (F.col("block") + F.col("further")).alias("no"))
        return each.groupBy("no").agg(F.collect_set("trigram").alias("have")).where(_passes(need, F.col("have"))).select("no")

    def find_lines(self, pattern: str, scope: str | None = None, file_glob: str | None = None, keys: tuple[str, ...] = ("path",)) -> DataFrame:
        """``pattern.find_lines`` over the lines of the indexed files: (keys, row, text, snippet)."""
        files, some = self.files, self.candidates(pattern)
        if scope:
            files = files.where(F.col("path").startswith(scope))
        if file_glob:
            files = files.where(path_passes_glob(F.col("path"), file_glob))
        if some is not None:
            few = some.count() <= BROADCAST_FILES
            files = files.join(F.broadcast(some) if few else some, "no", "left_semi")
        return find_lines(lines_of(files, list(keys), self.text_col), pattern)
