"""N-gram Jaccard self-join by T-occurrence search, to components of linked texts.

A text's set holds the hashes of its distinct word shingles (words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower
case; a text with fewer words is one shingle). Two sets link when ``den * |A & B| >= num * |A | B|``.

1. Texts with equal sets form a class, found by the set's hash; copies are never paired.
2. Shingles are put in one global order, rare ones first: those that recur within tasks are counted (a bounded list of
   the most frequent is broadcast), all others rank before them, by hash. Any order is exact. Those counted ``LONG`` times or
   more are common.
3. Linked sets A, B share at least T = ceil(num / den * |A|) shingles, so of the first |A| - T + k of their order, the short
   lists of DivideSkip, they share at least k, here k = 1 + (|A| - T) // 2 (the smaller of both sets'). A set with h common
   shingles among these leaves them out, and needs h fewer shared ones, as long as h is below the k of every possible
   partner: then at least one shared shingle is not common. Only sets with more of them post common shingles. Postings
   are grouped by shingle. Lists of up to ``SHORT`` sets count for each two of them what they share, and pairs below k
   go. In longer lists, up to ``LONG``, each set is held against the others by odd sketches, and a spanning forest of the
   possible partners is kept. Still longer ones give chains of sets of compatible sizes, within a task
   as one row, so a shingle that a third of all texts share costs each task one row. Pairs whose odd sketches
   (``ODD_BITS`` parities) differ in more bits than linked sets can differ in shingles are no partners.
   The connected components of what remains are the clusters that are searched exactly.
4. Within a cluster, each set is a query against the inverted lists of the others: the short lists are merged
   (a heap for few postings, a merge sort for many), the occurrences counted, and the partners' remaining overlap is
   found by binary probes for the long lists, stopping at the required overlap. Pairs that are connected already
   are not probed. A cluster of more than ``UNIT`` shingles is cut into units of about that many by size band and hash, and
   pairs of units are searched as separate tasks, so that no task holds more than about two units.
5. The links found (a forest for each task) are joined to components.

Set and shingle equality is by 64-bit hashes: n distinct shingles (or sets) clash with odds of about n^2 / 4e19. Only the search of one large cluster grows with the square of its
classes; it is spread over tasks and never written out as pairs.

Defined results: null or wordless texts have an empty set, link with nothing and are their own component;
repeated rows share a class; ids that are null have a null component; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, quoted, releasing, small_batches, stored
from .components import components
from .workers import Memo, kept

HEAVY = 500_000
UNIT = 1 << 19
POSTINGS = 500_000
SHORT = 16
LONG = 4096
LOCAL = 256
ODD_BITS = 512
ALWAYS = 1 << 40
FLUSH_WORDS = 4_000_000


def word_hashes(words: list[bytes]) -> np.ndarray:
    memo = kept("ngram_join", "words", lambda: Memo(xxhash.xxh3_64_intdigest, 40 << 20))
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | bytes | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes (uint64)."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = word_hashes(words)
    k = min(width, len(w))
    n = len(w) - k + 1
    s = np.full(n, k, np.uint64)
    for i in range(k):
        s = mix(s * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n])
    s.sort()
    return s if n == 1 else s[np.concatenate([[True], s[1:] != s[:-1]])]


def set_hash(s: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def odd_sketch(s: np.ndarray) -> bytes:
    """Parities of the number of shingles in m classes, m = ODD_BITS or the power of two that is at most |s|, if larger.

    A shingle that one of two sets lacks flips one bit, so their sketches differ in no more bits than the sets in
    shingles. A sketch of 2m bits folds to one of m by xor of its halves.
    """
    m = max(ODD_BITS, 1 << (len(s).bit_length() - 1))
    return np.packbits(np.bincount((s >> np.uint64(20)).astype(np.int64) & (m - 1), minlength=m).astype(np.uint8) & 1).tobytes()


def fold(k: np.ndarray) -> np.ndarray:
    """Sketches (uint64 words in the last axis) of half the bits."""
    half = k.shape[-1] // 2
    return k[..., :half] ^ k[..., half:]


def may_link(odd_a: bytes, odd_b: bytes, total: int, num: int, den: int) -> bool:
    """Whether sets of ``total`` shingles together can link, by their sketches."""
    x, y = np.frombuffer(odd_a, np.uint64), np.frombuffer(odd_b, np.uint64)
    while len(x) > len(y):
        x = fold(x)
    while len(y) > len(x):
        y = fold(y)
    return (num + den) * int(np.bitwise_count(x ^ y).sum(dtype=np.int64)) <= (den - num) * total


def required(n, num: int, den: int):
    """k: of their short lists, linked sets share at least the smaller of both sets' k."""
    return 1 + (n - -(-num * n // den)) // 2


def short_list(s: np.ndarray, heavy: np.ndarray, common: int, num: int, den: int) -> tuple[np.ndarray, int]:
    """The shingles that a set posts, and how many of them a linked set shares at least.

    ``heavy`` lists (hash, rank) rows by hash, rank from 1 for the rarest of them; ranks from ``common`` on are common.
    """
    need = required(len(s), num, den)
    keep = len(s) - -(-num * len(s) // den) + need
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy[:, 0], s), len(heavy) - 1)
        rank = np.where(heavy[at, 0] == s, heavy[at, 1], 0)
        if rank.any():
            order = np.argsort(rank, kind="stable")[:keep]
            many = int((rank[order] >= common).sum())
            if many < required(-(-num * len(s) // den), num, den):
                return s[order[: keep - many]], need - many
            return s[order], 1
    return s[:keep], need


def chain(tokens: np.ndarray, cls: np.ndarray, low: np.ndarray, high: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
    """Join rows of the same token whose size ranges can hold linked sets.

    Returns the edges (from, to) between classes and the joined rows (token, class, low, high). A row for several classes
    has low < high even if their sizes are equal, so that it is not taken for a single set.
    """
    order = np.lexsort((cls, low, tokens))
    t, c, lo, hi = tokens[order], cls[order], low[order], high[order]
    new = np.concatenate([[True], t[1:] != t[:-1]])
    group = np.cumsum(new)
    wide = np.int64(hi.max()) + 1
    top = np.maximum.accumulate(hi + group * wide) - group * wide  # the largest size so far in the token's run
    new[1:] |= den * top[:-1] < num * lo[1:]
    start = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    least, most = np.minimum.reduceat(c, start), np.maximum.reduceat(c, start)
    a, b = c, least[run]
    edges = np.unique(np.stack([a[a != b], b[a != b]], 1), axis=0) if (a != b).any() else np.empty((0, 2), np.int64)
    return edges[:, 0], edges[:, 1], (t[start], least, lo[start], np.maximum(np.maximum.reduceat(hi, start), lo[start] + (most != least)))


def short_pairs(tokens: np.ndarray, cls: np.ndarray, size: np.ndarray, need: np.ndarray, num: int, den: int) -> tuple[np.ndarray, ...]:
    """For rows sorted by token, with few classes each: (a, b, need of a, need of b, shared tokens) of possible partners."""
    out = []
    for d in range(1, SHORT):
        i = np.flatnonzero(tokens[d:] == tokens[:-d])
        if not len(i):
            break
        x, y = i, i + d
        ok = (cls[x] != cls[y]) & (den * np.minimum(size[x], size[y]) >= num * np.maximum(size[x], size[y]))
        x, y = x[ok], y[ok]
        swap = cls[x] > cls[y]
        out.append(np.stack([np.where(swap, y, x), np.where(swap, x, y)], 1))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    at = np.concatenate(out)
    pairs = np.stack([cls[at[:, 0]], cls[at[:, 1]], need[at[:, 0]], need[at[:, 1]]], 1)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    start = np.flatnonzero(np.concatenate([[True], (pairs[1:, :2] != pairs[:-1, :2]).any(1)])) if len(pairs) else np.empty(0, np.int64)
    return *pairs[start].T, np.diff(np.append(start, len(pairs)))


def list_forest(cls: np.ndarray, size: np.ndarray, odd: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of one list whose sizes and odd sketches allow a link."""
    order = np.argsort(size, kind="stable")
    cls, size = cls[order], size[order]
    sketches = [np.frombuffer(odd[i], np.uint64) for i in order.tolist()]
    wide = np.array([len(k) for k in sketches])  # does not fall, since the sizes do not
    starts = [0, *(np.flatnonzero(np.diff(wide)) + 1).tolist(), len(wide)]
    forest, out = Forest(len(cls)), []
    for n, (i0, i1) in enumerate(zip(starts, starts[1:])):
        own = np.stack(sketches[i0:i1])
        after = fold(np.stack(sketches[i1 : starts[n + 2]])) if n + 2 < len(starts) and wide[i1] == 2 * wide[i0] else None
        for i in range(i0, i1):
            end = int(np.searchsorted(size, size[i] * den // num, side="right"))
            for k, first, last in ((own, i0, i1), (after, i1, end)):
                j0, j1 = max(i + 1, first), min(end, last, first + len(k) if k is not None else 0)
                if j1 > j0:
                    differ = np.bitwise_count(k[j0 - first : j1 - first] ^ own[i - i0]).sum(1, dtype=np.int64)
                    ok = (num + den) * differ <= (den - num) * (size[j0:j1] + size[i])
                    out += [(int(cls[i]), int(cls[j0 + j])) for j in np.flatnonzero(ok).tolist() if forest.join(i, j0 + j)]
    return out


def by_list_length(tokens: np.ndarray, low: np.ndarray, high: np.ndarray, short: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by token: masks of short lists with two rows or more, and of longer ones (or with joined rows)."""
    short = SHORT if short is None else short
    start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.empty(0, np.int64)
    many = np.diff(np.append(start, len(tokens)))
    wide = np.add.reduceat((low != high).astype(np.int64), start) > 0 if len(start) else np.empty(0, bool)
    long = (many > short) | (wide & (many > 1))
    return np.repeat((many > 1) & ~long, many), np.repeat(long, many)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def search(sets: list[np.ndarray], num: int, den: int, split: int | None = None) -> list[tuple[int, int]]:
    """T-occurrence search among ``sets``: a spanning forest of the links, as pairs of positions.

    With ``split``, only pairs of one position below it and one not below are searched.
    """
    forest, links = Forest(len(sets)), []
    if len(sets) < 2:
        return links
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    postings, token = owner[order], flat[order]
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    ends = np.append(starts[1:], len(token))
    keys = token[starts]
    for q in range(len(sets)):
        s = sets[q]
        at = np.searchsorted(keys, s)
        length = ends[at] - starts[at]
        least = -(-num * len(s) // den)  # the overlap that any partner needs
        by_length = np.argsort(length, kind="stable")
        short, long = by_length[: len(s) - least + 1], by_length[len(s) - least + 1 :]
        runs = [postings[starts[k] : ends[k]] for k in at[short].tolist() if ends[k] - starts[k] > 1]
        if not runs:
            continue
        if sum(map(len, runs)) <= 128:
            counts = Counter(heapq.merge(*[r.tolist() for r in runs]))
            found, hits = np.array(list(counts)), np.array(list(counts.values()))
        else:
            found, hits = np.unique(np.concatenate(runs), return_counts=True)
        ok = found < q if split is None else (found >= split) != (q >= split)
        if split is not None:
            ok &= found < q
        ok &= (den * sizes[found] >= num * len(s)) & (den * len(s) >= num * sizes[found])
        probe = s[long]
        for b, h in sorted(zip(found[ok].tolist(), hits[ok].tolist()), key=lambda x: -x[1]):
            if forest.find(q) == forest.find(b):
                continue
            need = -(-num * (len(s) + len(sets[b])) // (num + den))
            if h + min(len(probe), len(sets[b]) - h) < need:
                continue
            p = np.searchsorted(sets[b], probe)
            p[p == len(sets[b])] = 0
            if h + int((sets[b][p] == probe).sum()) >= need:
                forest.join(q, b)
                links.append((q, b))
    return links


def _pack(*columns: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(c).tobytes() for c in columns]


def link_components(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, buckets: int | None = None) -> DataFrame:
    """Per row: ``id_col``, n_shingles long, component_id long (smallest linked id, itself included)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sievework.llm.ngram_join import odd_sketch, set_hash, shingle_set

        schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("odd", pa.binary()), ("heavy", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))])
        held, n_held = [], 0

        def frequent() -> pa.RecordBatch:
            v, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c >= 4
            v, c = v[keep].view(np.int64), c[keep]
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([v], pa.list_(pa.int64())), pa.array([c], pa.list_(pa.int64()))], schema=schema)

        for b in batches:
            ns, cs, odd = [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, width)
                ns.append(len(s))
                cs.append(set_hash(s) if len(s) else None)
                odd.append(odd_sketch(s) if len(s) else None)
                held.append(s)
                n_held += len(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(cs, pa.int64()), pa.array(odd, pa.binary()), pa.nulls(len(ns), pa.list_(pa.int64())), pa.nulls(len(ns), pa.list_(pa.int64()))], schema=schema)
            if n_held > FLUSH_WORDS:
                yield frequent()
                held, n_held = [], 0
        if n_held:
            yield frequent()

    described = stored(rows.mapInArrow(releasing(describe), "id long, n long, cls long, odd binary, heavy array<long>, times array<long>"), "sets")
    info = described.where("heavy IS NULL").select("id", "n", "cls", "odd")
    classes = info.where("cls IS NOT NULL AND id IS NOT NULL").groupBy("cls").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("odd").alias("odd"))
    often = described.where("heavy IS NOT NULL").select(F.explode(F.arrays_zip("heavy", "times")).alias("x"))
    often = often.groupBy("x.heavy").agg(F.sum("x.times").alias("times")).orderBy(F.desc("times"), "heavy").limit(HEAVY).toArrow()
    heavy = np.stack([often["heavy"].to_numpy().view(np.uint64), np.arange(often.num_rows, 0, -1, dtype=np.uint64)], 1) if often.num_rows else np.empty((0, 2), np.uint64)
    common = int((often["times"].to_numpy() < LONG).sum()) + 1  # the rank of the rarest common shingle
    shared = spark.sparkContext.broadcast(heavy[np.argsort(heavy[:, 0], kind="stable")])
    n_shingles = info.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # about 2 (1 - num / den) of the shingles are posted
    buckets = buckets or max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * (den - num) * n_shingles // (den * POSTINGS)))

    def posting_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sievework.llm.ngram_join import _pack, by_list_length, chain, set_hash, shingle_set, short_list

        rank, seen, held, n_held = shared.value, set(), [], 0
        names = ["bucket", "tokens", "cls", "low", "high", "need", "a", "b"]

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate([h[0] for h in held])
            many = [len(h[0]) for h in held]
            cls, size, need = (np.repeat(np.array([h[k] for h in held], np.int64), many) for k in (1, 2, 3))
            order = np.argsort(tokens, kind="stable")
            tokens, cls, size, need = tokens[order], cls[order], size[order], need[order]
            _, long = by_list_length(tokens, size, size, LOCAL)
            a, b, joined = chain(tokens[long], cls[long], size[long], size[long], num, den) if long.any() else (np.empty(0, np.int64), np.empty(0, np.int64), None)
            low = high = size
            if joined:
                tokens, cls, low, high, need = (np.concatenate([x[~long], y]) for x, y in zip((tokens, cls, size, size, need), (*joined, np.ones(len(joined[0]), np.int64))))
            bucket = (tokens % np.uint64(buckets)).astype(np.int64)
            token = (tokens >> np.uint64(32)).astype(np.uint32)  # in a bucket 32 bits will do: a clash only adds a candidate
            low, high, need = low.astype(np.int32), high.astype(np.int32), np.minimum(need, 65535).astype(np.uint16)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            out = [(int(bucket[p[0]]), *_pack(token[p], cls[p], low[p], high[p], need[p]), b"", b"") for p in np.split(order, cuts)]
            if len(a):
                out.append((int(a[0]) % buckets, b"", b"", b"", b"", b"", *_pack(a, b)))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), *[pa.array([r[k] for r in out], pa.binary()) for k in range(1, 8)]], names)

        for batch in batches:
            for t in batch.column(0).to_pylist():
                s = shingle_set(t, width)
                if den * len(s) < num * (len(s) + 1):  # too small for a partner of another set
                    continue
                c = set_hash(s)
                if c in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(c)
                tokens, need = short_list(s, rank, common, num, den)
                held.append((tokens, c, len(s), need))
                n_held += len(held[-1][0])
            if n_held > FLUSH_WORDS // 4:
                yield flush()
                held, n_held = [], 0
        if held:
            yield flush()

    posted = rows.where("text IS NOT NULL AND id IS NOT NULL").select("text").mapInArrow(releasing(posting_rows), "bucket long, tokens binary, cls binary, low binary, high binary, need binary, a binary, b binary")

    def join_lists(key: tuple, t: pa.Table) -> pa.Table:
        from sievework.llm.ngram_join import ALWAYS, LONG, SHORT, by_list_length, chain, short_pairs

        kinds = (("tokens", np.uint32), ("cls", np.int64), ("low", np.int32), ("high", np.int32), ("need", np.uint16), ("a", np.int64), ("b", np.int64))
        tokens, cls, low, high, need, a0, b0 = (np.frombuffer(b"".join(t[c].to_pylist()), k) for c, k in kinds)
        order = np.lexsort((high, low, cls, tokens))
        tokens, cls, low, high, need = tokens[order], cls[order], low[order].astype(np.int64), high[order].astype(np.int64), need[order].astype(np.int64)
        if len(tokens):  # a copy of a class in another task is the same row
            new = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (cls[1:] != cls[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
            tokens, cls, low, high, need = tokens[new], cls[new], low[new], high[new], need[new]
        short, more = by_list_length(tokens, low, high, SHORT)
        _, huge = by_list_length(tokens, low, high, LONG)
        long = more & ~huge
        a, b, na, nb, shared = short_pairs(tokens[short], cls[short], low[short], need[short], num, den)
        c, d, _ = chain(tokens[huge], cls[huge], low[huge], high[huge], num, den) if huge.any() else (np.empty(0, np.int64), np.empty(0, np.int64), None)
        x, y, none = np.concatenate([c, a0]), np.concatenate([d, b0]), np.zeros(len(c) + len(a0), np.int64)
        names = np.int64(key[0].as_py()) << 32 | tokens[long].astype(np.int64)
        parts = (a, np.minimum(x, y), cls[long]), (b, np.maximum(x, y), names), (na, none, low[long]), (nb, none, low[long]), (shared, none + ALWAYS, np.full(int(long.sum()), -1))
        return pa.table({k: np.concatenate(p) for k, p in zip(("a", "b", "na", "nb", "shared"), parts)})

    raw = stored(posted.groupBy("bucket").applyInArrow(join_lists, "a long, b long, na long, nb long, shared long"), "lists")
    met = raw.where((F.col("shared") >= 0) & (F.col("shared") < ALWAYS)).groupBy("a", "b").agg(F.sum(F.col("shared").cast("double")).alias("shared"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    pairs = met.where(F.col("shared") >= F.least("na", "nb")).select("a", "b")
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"odd{c}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sievework.llm.ngram_join import may_link

        for t in batches:
            r = t.to_pydict()
            keep = [may_link(x, y, m + n, num, den) for x, y, m, n in zip(r["odda"], r["oddb"], r["na"], r["nb"])]
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = pairs.select("a", "b", "na", "nb", "odda", "oddb").mapInArrow(releasing(partners), "a long, b long")

    def link_lists(key: tuple, t: pa.Table) -> pa.Table:
        from sievework.llm.ngram_join import list_forest

        t = t.sort_by([("list", "ascending"), ("cls", "ascending")])
        lists, cls, size = t["list"].to_numpy(), t["cls"].to_numpy(), t["size"].to_numpy()
        odd = t["odd"].to_pylist()
        cuts = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(lists)]
        found = {e for i, j in zip(cuts, cuts[1:]) for e in list_forest(cls[i:j], size[i:j], odd[i:j], num, den)}
        return pa.table({"a": pa.array([e[0] for e in found], pa.int64()), "b": pa.array([e[1] for e in found], pa.int64())})

    long_rows = raw.where("shared < 0").select(F.col("a").alias("cls"), F.col("b").alias("list"), F.col("na").alias("size")).join(classes.select("cls", "odd"), "cls")
    listed = long_rows.groupBy(F.pmod(F.xxhash64("list"), F.lit(buckets)).alias("bucket")).applyInArrow(link_lists, "a long, b long")
    near = pairs.unionAll(listed).unionAll(raw.where(F.col("shared") >= ALWAYS).select("a", "b"))  # chains need no sketches
    clusters = components(near).select(F.col("node").alias("cls"), F.col("component").alias("cluster"))
    members = stored(clusters.join(classes.drop("odd"), "cls"), "members")
    drop(raw)
    counts = members.groupBy("cluster").agg(F.sum("n").alias("w"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(den / num)))).cast("long")
    units = F.ceil(F.col("w") / F.lit(UNIT)).cast("long")
    placed = members.join(counts, "cluster").withColumns({"u": F.when(F.col("w") <= UNIT, 0).otherwise(units), "band": band, "part": F.pmod(F.xxhash64("cls"), units)})

    # A unit is (band, part) in one number; a task is a pair of units whose bands are equal or adjacent.
    unit = lambda b, p: b * F.lit(1 << 20) + p
    own = unit(F.col("band"), F.col("part"))
    others = F.flatten(F.transform(F.sequence(F.col("band") - 1, F.col("band") + 1), lambda b: F.transform(F.sequence(F.lit(0), F.col("u") - 1), lambda p: unit(b, p))))
    tasks = F.when(F.col("u") == 0, F.array(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("own")))).otherwise(
        F.transform(others, lambda o: F.struct(F.least(own, o).alias("x"), F.greatest(own, o).alias("y"), own.alias("own")))
    )
    wanted = placed.select("rep", "cls", "cluster", tasks.alias("tasks"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sievework.llm.ngram_join import set_hash, shingle_set

        for b in batches:
            sets = [shingle_set(t, width) for t in b.column(3).to_pylist()]
            fit = pa.array([bool(len(s)) and set_hash(s) == c for s, c in zip(sets, b.column(1).to_pylist())])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(4), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "cluster", "tasks", "shingles"]).filter(fit)

    # always by shuffle: the wanted sets grow with the input, and small ones should behave like large ones
    texts = rows.join(wanted.hint("shuffle_hash"), F.col("rep") == F.col("id")).select("rep", "cls", "cluster", "text", "tasks")
    sets = texts.mapInArrow(releasing(fetch), "rep long, cluster long, tasks array<struct<x: long, y: long, own: long>>, shingles binary")
    spread = sets.select("rep", "cluster", F.explode("tasks").alias("task"), "shingles")
    spread = spread.select("rep", "cluster", F.col("task.x").alias("x"), F.col("task.y").alias("y"), F.col("task.own").alias("own"), "shingles")

    def search_task(key: tuple, t: pa.Table) -> pa.Table:
        from sievework.llm.ngram_join import search

        t = t.sort_by([("own", "ascending"), ("rep", "ascending")])
        rep, own_ = t["rep"].to_numpy(), t["own"].to_numpy()
        fresh = np.concatenate([[True], rep[1:] != rep[:-1]])
        rep, own_ = rep[fresh], own_[fresh]
        found = [np.frombuffer(s, np.uint64) for s, f in zip(t["shingles"].to_pylist(), fresh) if f]
        across = key[1].as_py() != key[2].as_py()
        links = search(found, num, den, int((own_ == own_[0]).sum()) if across else None) if not across or own_[0] != own_[-1] else []
        return pa.table({"a": rep[[q for q, _ in links]] if links else np.empty(0, np.int64), "b": rep[[b for _, b in links]] if links else np.empty(0, np.int64)})

    links = spread.groupBy("cluster", "x", "y").applyInArrow(search_task, "a long, b long")
    linked = components(links)
    of_class = classes.join(linked, F.col("rep") == F.col("node"), "left").select("cls", F.coalesce("component", "rep").alias("component"))
    i, c = info.alias("i"), of_class.alias("c")
    return i.join(c, F.col("i.cls") == F.col("c.cls"), "left").select(F.col("i.id").alias(id_col), F.col("i.n").alias("n_shingles"), F.when(F.col("i.id").isNotNull(), F.coalesce(F.col("c.component"), F.col("i.id"))).alias("component_id"))
