"""Best-fit packing of tokenised documents into sequences of a fixed length.

Each task tokenises its documents, cuts those longer than a sequence, and packs the pieces with bounded-space online
best-fit: at most ``OPEN_BINS`` bins are open, filed in a bitset keyed by free space, so the
tightest bin that takes a piece is the lowest set bit at or above its length. When a new bin is needed and
all places are taken, the fullest open bin closes first. Pieces reach the packer in runs of up to ``LOOKAHEAD``,
longest first within a run. Bins still open at the end of a task travel on as single items: they are merged by the
same packer in groups of tasks, so what is lost to half-full bins does not grow with the number of tasks.

Tokenising remembers ids by white-space-free chunk, in a bounded memory, where the tokenizer's file says that it lower-cases,
cuts words out by ``WORDS`` and drops white space: then no piece of a text reaches across a blank or a line feed, and a chunk
of Latin letters has the ids of the word in lower case, then those of a stop or comma behind it. Such words go to the tokenizer's
merges directly, many at a time. With any other tokenizer file each text is tokenised as a whole.

Defined results: a null text is empty and holds only the end id, so every row gives at least one piece; repeated rows
are packed separately; an empty table gives no rows. Sequence ids are arbitrary and distinct.
"""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, small_batches, stored
from .wordtable import blocks

CAPACITY = 4096
END_ID = 1
OPEN_BINS = 512
LOOKAHEAD = 1 << 15
GROUP = 64
MEMORY = 160 << 20
LONGEST = 40
BLOCK_CHARS, RUN = 6 << 20, 20_000
# The pattern by which the tokenizers that may be applied chunk by chunk cut out words, and their normalisers.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Letters that neither normalising nor lower-casing turns into anything but letters (the dotted capital I becomes an i and a mark).
LATIN = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([.,]?)")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Packer:
    """Bounded-space best-fit over items of length 1 to ``capacity``; ``place`` returns (bin, offset)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.by_free, self.n_open, self.n_bins = 0, {}, 0, 0

    def place(self, length: int) -> tuple[int, int]:
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            k = self._take(free)
        else:
            if length < self.capacity and self.n_open >= self.open_bins:  # a full piece needs no place
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            k, free = self.n_bins, self.capacity
            self.n_bins += 1
        left = free - length
        if left:
            self.by_free.setdefault(left, []).append(k)
            self.bits |= 1 << left
            self.n_open += 1
        return k, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        k = bins.pop()
        if not bins:
            self.bits ^= 1 << free
            del self.by_free[free]
        self.n_open -= 1
        return k

    def still_open(self) -> dict[int, int]:
        """Open bin -> its used length."""
        return {k: self.capacity - free for free, bins in self.by_free.items() for k in bins}


class TextIds:
    """Little-endian 32-bit ids of texts, as bytes. Words that are not remembered are tokenised together.

    Chunks of up to ``LONGEST`` characters are remembered, in two generations of half of ``memory`` bytes: the older one is
    dropped when the newer is full.
    """

    ENTRY = 230  # the usual bytes of an entry; up to LONGEST characters no more than 500

    def __init__(self, tokenizer_file: str, memory: int = MEMORY):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_chunk = _cuts_at_blanks(spec)
        self.newer, self.older, self.half, self.size = {}, {}, memory // 2, 0
        if self.by_chunk:
            # the same merges for words in lower case with blanks between them
            pre = [{"type": "CharDelimiterSplit", "delimiter": " "}, *spec["pre_tokenizer"]["pretokenizers"][1:]]
            self.merges = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": pre}}))
            suffix = spec["model"]["end_of_word_suffix"]
            self.marks = dict(zip(".,", self._encode([".", ","])))
            self.ends = np.zeros(1 + max(spec["model"]["vocab"].values()), bool)
            self.ends[[k for t, k in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters in lower case: each ends with its first token that ends a word."""
        ids = np.array(self.merges.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        last = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *last], last)] if len(last) == len(words) else self._encode(words)

    def of(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        if not self.by_chunk:
            return self._encode([t or "" for t in texts])
        paused = gc.isenabled()
        gc.disable()  # millions of short-lived strings and no cycles
        try:
            return self._by_chunk(texts)
        finally:
            if paused:
                gc.enable()

    def _by_chunk(self, texts: list[str | None]) -> list[bytes]:
        chunks = [(t or "").replace("\n", " ").split(" ") for t in texts]
        if self.size > self.half:
            self.older, self.newer, self.size = self.newer, {}, 0
        known, older, had = self.newer, self.older, len(self.newer)
        missing = set().union(*chunks).difference(known)
        for c in missing.intersection(older):
            known[c] = older[c]
        parts, others = {}, []
        for c in missing.difference(older):
            m = LATIN.fullmatch(c)
            if m:
                parts[c] = m[1].lower(), m[2]
            else:
                others.append(c)
        bases = {p[0] for p in parts.values()}
        ids = {c: known[c] for c in bases.intersection(known)}
        words, long = list(bases.difference(ids)), {}
        for k in range(0, len(words), RUN):
            ids.update(zip(words[k : k + RUN], self._words(words[k : k + RUN])))
        for c, (base, tail) in parts.items():
            (known if len(c) <= LONGEST else long)[c] = ids[base] + self.marks[tail] if tail else ids[base]
        for k in range(0, len(others), RUN):
            for c, got in zip(others[k : k + RUN], self._encode(others[k : k + RUN])):
                (known if len(c) <= LONGEST else long)[c] = got
        self.size += self.ENTRY * (len(known) - had)
        find = (known | long if long else known).__getitem__
        return [b"".join(map(find, x)) for x in chunks]


def _cuts_at_blanks(spec: dict) -> bool:
    """Whether a tokenizer file describes what the rules for chunks rely on."""
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    cuts = first.get("type") == "Split" and first.get("pattern") == {"Regex": WORDS} and first.get("behavior") == "Removed" and first.get("invert") is True
    steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    blanks = any(c.isspace() for t in spec.get("added_tokens", []) for c in t["content"])
    return cuts and steps == NORMALIZERS and not blanks and not spec.get("post_processor")


def cut(ids: bytes, capacity: int) -> Iterable[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids."""
    step = 4 * capacity
    for k, a in enumerate(range(0, len(ids), step)):
        part = ids[a : a + step]
        yield k, a // 4, len(part) // 4, zlib.crc32(part)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pack(docs: DataFrame, id_col: str, text_col: str, tokenizer_file: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = END_ID) -> DataFrame:
    """Per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    small_batches(spark)
    end = int(end_id).to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "bin", "offset", "open"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sievework.llm.packing import TextIds, default_tokenizer
        from sievework.llm.workers import kept

        file = tokenizer_file or default_tokenizer()
        ids, packer, task = kept("packing", "ids", lambda: TextIds(file), file), Packer(capacity, open_bins), TaskContext.get().partitionId()
        waiting: list[tuple] = []
        done: list[tuple] = []

        def flush() -> None:
            waiting.sort(key=lambda p: -p[3])
            done.extend((*p, task, *packer.place(p[3])) for p in waiting)
            waiting.clear()

        def out(rows: list[tuple], still: dict[int, int]) -> pa.RecordBatch:
            cols = list(zip(*[(*r, r[6] in still) for r in rows]))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for b in batches:
            doc_ids = iter(b.column(0).to_pylist())
            for some in blocks(b.column(1).to_pylist(), BLOCK_CHARS):
                for got in ids.of(some):
                    doc_id = next(doc_ids)
                    waiting.extend((doc_id, *p) for p in cut(got + end, capacity))
            if len(waiting) >= LOOKAHEAD:
                flush()
                still = packer.still_open()
                ready = [r for r in done if r[6] not in still]
                done = [r for r in done if r[6] in still]
                for k in range(0, len(ready), 10_000):
                    yield out(ready[k : k + 10_000], {})
        flush()
        still = packer.still_open()
        for k in range(0, len(done), 10_000):
            yield out(done[k : k + 10_000], still)

    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    pieces = stored(rows.mapInArrow(run, f"{PIECES}, task long, bin long, offset long, open boolean"), "pieces")

    def merge(key: tuple, items: pa.Table) -> pa.Table:
        items = items.sort_by([("used", "descending"), ("task", "ascending"), ("bin", "ascending")])
        packer = Packer(capacity, open_bins)
        placed = [packer.place(u) for u in items["used"].to_pylist()]
        return pa.table({"task": items["task"], "bin": items["bin"], "to": pa.array([(-1 - key[0].as_py()) << 32 | k for k, _ in placed], pa.int64()), "shift": pa.array([s for _, s in placed], pa.int64())})

    left = pieces.where("open").groupBy("task", "bin").agg(F.sum("length").alias("used"))
    left = left.withColumn("group", F.floor(F.col("task") / GROUP).cast("long"))
    moved = left.groupBy("group").applyInArrow(merge, "task long, bin long, to long, shift long")
    p, m = pieces.alias("p"), moved.alias("m")
    both = p.join(m, (F.col("p.task") == F.col("m.task")) & (F.col("p.bin") == F.col("m.bin")), "left")
    return both.select(
        F.col("p.doc_id").alias(id_col), "p.piece", "p.start", "p.length", "p.ids_crc32",
        F.coalesce(F.col("m.to"), F.shiftleft(F.col("p.task"), 32) + F.col("p.bin")).alias("sequence_id"),
        (F.col("p.offset") + F.coalesce(F.col("m.shift"), F.lit(0))).alias("offset"),
    )
