"""Language-model scoring by prediction by partial matching (PPM) over bytes, with a word unigram baseline.

The model is a byte-context trie of depth ``ORDER`` with the counts of all training texts. A symbol's probability
starts at the longest context; a context that has not seen it gives way to the next shorter one at the cost of
an escape (method C: d / (N + d) for d distinct symbols in N occurrences), and the symbols that longer contexts
have seen are excluded from the shorter ones' counts. Below order 0, the bytes never seen share what is left. A text is
coded from a start-of-text context to an end symbol, so the scores of all texts are one distribution.

For a trained trie a symbol's code length depends only on the symbol and its ORDER bytes of context, so
each block of texts needs one answer for each distinct such gram. Nothing of the model is held whole anywhere:

1. Tasks gather texts to blocks of about ``BLOCK_BYTES`` and emit the block itself (compressed), its distinct grams
   with their training counts, and its distinct words with theirs, cut into buckets, whose number follows the counted bytes. Grams
   of one bucket share their last three context symbols, so a bucket holds whole subtrees of the trie.
2. Orders 0 to 2 come from tables of global counts: of 257 x 257 pairs, and of the triples that occur (at most 257 ^ 3, some
   100,000 in texts of a few languages), summed by partial aggregates. One task per bucket adds up the counts of the longer
   contexts over all blocks, computes the code lengths of all grams that occur, and
   answers each block in the block's own order. Another does the same for words.
3. Blocks meet their answers and sum them per text.

A text longer than two blocks is cut after white space into pieces of about a block, which carry the symbols before them as
context; its sums are added up at the end. Only a run of that length without white space is held whole.

Everything is proportional to the input: a block's grams and words are fewer than its bytes. Words are
known by 64-bit hashes: n distinct words clash with odds of about n^2 / 4e19.

A symbol is one of the 256 bytes or ``MARK``, which ends a text and stands before its start.

Defined results: a null or empty text has only its end token; repeated rows are learned and scored
each; rows with a null id are training rows; with no training rows N is 0 and every symbol has probability 1/257.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, small_batches, stored

ORDER = 5
BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 4 << 20
SYMBOLS, MARK, BITS = 257, 256, 9
SPACE = b" \t\n\v\f\r"
_CODEC = "zstd"


class Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def squeeze(a: np.ndarray) -> bytes:
    """An integer array as bytes: differences, by byte planes, compressed."""
    a = a.astype(np.uint64, copy=False)
    d = np.diff(a, prepend=np.uint64(0)).astype("<u8")
    return len(a).to_bytes(8, "little") + pa.Codec(_CODEC).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T), asbytes=True)


def expand(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    planes = np.frombuffer(pa.Codec(_CODEC).decompress(b[8:], decompressed_size=8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def cut_text(text: bytes, most: int) -> list[tuple[int, int]]:
    """Ranges of a long text that end after white space."""
    out, a = [], 0
    while len(text) - a > 2 * most:
        b = max(text.rfind(c, a, a + most) for c in (SPACE[k : k + 1] for k in range(6)))
        if b < 0:
            later = [x for k in range(6) if (x := text.find(SPACE[k : k + 1], a + most)) >= 0]
            if not later:
                break
            b = min(later)
        out.append((a, b + 1))
        a = b + 1
    return [*out, (a, len(text))]


def grams_of(texts: list[bytes], lead: np.ndarray | None = None, final: np.ndarray | None = None, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all symbols with their contexts, and how many each text has.

    ``lead`` has the symbols before each text (by default its start), ``final`` says which of them end (by default all). A code holds
    the context from its latest symbol to its earliest, then the symbol: sorted codes keep the subtree of every context together.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    lead = np.full((len(texts), order), MARK, np.uint16) if lead is None else lead
    final = np.ones(len(texts), bool) if final is None else final
    buf = np.frombuffer(b"".join([x for t in texts for x in (bytes(order), t, b"\0")]), np.uint8).astype(np.uint16)
    start = np.cumsum(size + order + 1) - size - order - 1
    buf[start[:, None] + np.arange(order)] = lead
    buf[start + order + size] = MARK
    n = len(buf) - order
    codes = np.zeros(max(n, 0), np.uint64)
    for k in range(1, order + 1):
        codes <<= np.uint64(BITS)
        codes |= buf[order - k : order - k + n]
    codes <<= np.uint64(BITS)
    codes |= buf[order:]
    del buf
    keep = np.ones(max(n, 0), bool)
    keep[(start[1:, None] - order + np.arange(order)).reshape(-1)] = False  # the next text's lead is no symbol of this one
    keep[(start + size)[~final]] = False
    return codes[keep], size + final


def distinct(codes: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes, and how often each occurs where ``trained``."""
    learn, rest = codes[trained], codes[~trained]
    learn.sort()
    new = np.concatenate([[True], learn[1:] != learn[:-1]]) if len(learn) else np.empty(0, bool)
    at = np.flatnonzero(new)
    u, c = learn[at], np.diff(np.append(at, len(learn)))
    del learn, new, at
    if not len(rest):
        return u, c
    allu = np.union1d(u, rest)
    counts = np.zeros(len(allu), np.int64)
    counts[np.searchsorted(allu, u)] = c
    return allu, counts


def bucket_of(codes: np.ndarray, buckets: int, order: int = ORDER) -> np.ndarray:
    near = codes >> np.uint64(BITS * (order - 2))  # the three latest symbols of the context
    return ((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets


def pair_of(codes: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The latest symbol of the context and the symbol, as one number below 257 ^ 2."""
    return ((codes >> np.uint64(BITS * order)) * np.uint64(SYMBOLS) + (codes & np.uint64(511))).astype(np.int64)


def triple_of(codes: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The two latest symbols of the context and the symbol, as one number below 2 ^ 27."""
    return ((codes >> np.uint64(BITS * (order - 1)) << np.uint64(BITS)) | (codes & np.uint64(511))).astype(np.int64)


class LowOrders:
    """The counts of orders 0 to 2 over all training texts."""

    def __init__(self, pairs: np.ndarray, keys: np.ndarray, counts: np.ndarray):
        """``pairs`` [context symbol, symbol]; ``keys`` (as in ``triple_of``, sorted) with their ``counts``, all above 0."""
        self.pairs, self.keys, self.counts = pairs, keys, counts.astype(np.float64)
        ctx = keys >> BITS
        start = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.empty(0, np.int64)
        self.contexts, self.kinds = ctx[start], np.diff(np.append(start, len(ctx))).astype(np.float64)
        below = pairs[(ctx >> BITS), keys & 511].astype(np.float64)
        total = lambda v: np.add.reduceat(v, start) if len(start) else np.empty(0)
        self.totals, self.known = total(self.counts), total(below)

    @staticmethod
    def _find(sorted_keys: np.ndarray, wanted: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        """The values at the wanted keys; 0 for keys that are not there."""
        if not len(sorted_keys):
            return [np.zeros(len(wanted)) for _ in values]
        at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
        there = sorted_keys[at] == wanted
        return [np.where(there, v[at], 0) for v in values]

    def triples(self, t: np.ndarray) -> np.ndarray:
        return self._find(self.keys, t, self.counts)[0]

    def contexts_of(self, t: np.ndarray) -> list[np.ndarray]:
        """Per triple: its context's occurrences, distinct symbols, and the sum of the order 1 counts of these."""
        return self._find(self.contexts, t >> BITS, self.totals, self.kinds, self.known)


def code_lengths(u: np.ndarray, n: np.ndarray, low: LowOrders, order: int = ORDER) -> np.ndarray:
    """log10 probability of each gram in ``u`` (sorted; whole subtrees of three-symbol contexts) with training counts ``n``."""
    pairs, bits, mask = low.pairs, np.uint64(BITS), np.uint64(511)
    sym, last = (u & mask).astype(np.int64), (u >> np.uint64(BITS * order)).astype(np.int64)
    ones = pairs.sum(0)
    levels = []  # from the longest context to order 0: per gram n_k(s), N_k, d_k, and the sum of n_(k-1) over what it has seen
    keys, counts, spread = u, n.astype(np.float64), np.arange(len(u))
    for k in range(order, 2, -1):
        ctx = keys >> bits
        start = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]]))
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(ctx))))
        seen = counts > 0
        total, kinds = np.add.reduceat(counts, start), np.add.reduceat(seen.astype(np.float64), start)
        shorter = (ctx >> bits) << bits | (keys & mask)
        if k > 3:
            keys_below, inv = np.unique(shorter, return_inverse=True)
            counts_below = np.bincount(inv, counts, len(keys_below))
            below = counts_below[inv]
        else:
            below = low.triples(shorter.astype(np.int64))
        known_below = np.add.reduceat(np.where(seen, below, 0), start)
        levels.append((counts[spread], total[group][spread], kinds[group][spread], known_below[group][spread]))
        if k > 3:
            spread, keys, counts = inv[spread], keys_below, counts_below
    t = triple_of(u, order)
    levels.append((low.triples(t), *low.contexts_of(t)))
    seen_ones = np.where(pairs > 0, ones[None, :], 0).sum(1).astype(np.float64)
    levels.append((pairs[last, sym].astype(np.float64), pairs.sum(1)[last].astype(np.float64), (pairs > 0).sum(1)[last].astype(np.float64), seen_ones[last]))
    levels.append((ones[sym].astype(np.float64), np.full(len(u), float(ones.sum())), np.full(len(u), float((ones > 0).sum())), np.zeros(len(u))))
    out, open_, gone_n, gone_d = np.zeros(len(u)), np.ones(len(u), bool), np.zeros(len(u)), np.zeros(len(u))
    for own, total, kinds, known_below in levels:
        free, novel = total - gone_n, kinds - gone_d
        use = open_ & (novel > 0)
        hit = use & (own > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(hit, np.log10(own / (free + novel)), 0) + np.where(use & ~hit, np.log10(novel / (free + novel)), 0)
        open_ &= ~hit
        gone_n, gone_d = known_below, kinds
    return out - np.where(open_, np.log10(np.maximum(1, SYMBOLS - (ones > 0).sum())), 0)


A_TABLE = "kind int, block long, bucket long, a binary, b binary, c binary, d binary"
_A_SCHEMA = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
TEXTS, GRAMS, WORDS, PAIRS, TRIPLES = 0, 1, 2, 3, 4


def split_buckets(bucket: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bucket, positions in order) for each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
    return [(int(bucket[p[0]]), p) for p in parts if len(p)]


def words_of(texts: list[bytes]) -> tuple[Numbers, list[np.ndarray]]:
    numbers = Numbers()
    get = numbers.__getitem__
    out = []
    for t in texts:
        w = t.lower().split()
        out.append(np.fromiter(map(get, w), np.int64, len(w)))
    return numbers, out


def word_hashes(numbers: Numbers) -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes, and the place of each word number among them."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
    u, place = np.unique(h, return_inverse=True)
    return u, place


class Pieces:
    """The texts and pieces of texts of a block."""

    def __init__(self, order: int):
        self.order, self.key, self.ids, self.held, self.texts, self.lead, self.final, self.size = order, [], [], [], [], [], [], 0

    def add(self, key: int, doc_id: int | None, held: bool, text: bytes, lead: bytes | None, final: bool) -> None:
        self.key.append(key)
        self.ids.append(doc_id)
        self.held.append(held)
        self.texts.append(text)
        self.lead.append([MARK] * self.order if lead is None else [MARK] * (self.order - len(lead)) + list(lead))
        self.final.append(final)
        self.size += len(text)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.held, bool), np.array(self.lead, np.uint16).reshape(-1, self.order), np.array(self.final, bool)


def block_rows(block: int, pieces: Pieces, buckets: int) -> Iterator[tuple]:
    """The rows of A_TABLE for one block."""
    order, texts, ids = pieces.order, pieces.texts, pieces.ids
    held, lead, final = pieces.arrays()
    blob = b"".join(texts)
    about = [np.array([-1 if i is None else i for i in ids], "<i8"), np.array([i is None for i in ids], np.uint8), np.array(pieces.key, "<i8"), final.astype(np.uint8), lead.astype("<u2")]
    yield TEXTS, block, -1, b"".join(x.tobytes() for x in about), held.astype(np.uint8).tobytes(), np.array([len(t) for t in texts], "<i8").tobytes(), len(blob).to_bytes(8, "little") + pa.Codec(_CODEC).compress(blob, asbytes=True)
    del blob
    codes, many = grams_of(texts, lead, final, order)
    u, c = distinct(codes, np.repeat(~held, many))
    del codes
    for k, p in split_buckets(bucket_of(u, buckets, order)):
        yield GRAMS, block, k, squeeze(u[p]), squeeze(c[p]), None, None
    learned = c > 0
    for kind, of in ((PAIRS, pair_of), (TRIPLES, triple_of)):
        keys, inv = np.unique(of(u[learned], order), return_inverse=True)
        yield kind, block, -1, squeeze(keys), squeeze(np.bincount(inv, c[learned], len(keys))), None, None
    del u, c
    numbers, per_text = words_of(texts)
    h, place = word_hashes(numbers)
    learned = [w for w, x in zip(per_text, held) if not x]
    counts = np.bincount(place[np.concatenate(learned)], minlength=len(h)) if learned and len(h) else np.zeros(len(h), np.int64)
    for k, p in split_buckets((h >> np.uint64(20)).astype(np.int64) % buckets):
        yield WORDS, block, k, squeeze(h[p]), squeeze(counts[p]), None, None


def score_block(row: dict, grams: dict[int, np.ndarray], words: dict[int, np.ndarray], buckets: int, order: int, log_end: float, end_known: bool) -> tuple[list, ...]:
    """Per piece of a block: key, id, held out, n_tokens, n_known, the sum of log10(c + 0.5), the log10 probability."""
    n, at = len(row["b"]), 0
    about = []
    for kind, width in (("<i8", 8), ("u1", 1), ("<i8", 8), ("u1", 1), ("<u2", 2 * order)):
        about.append(np.frombuffer(row["a"], kind, offset=at, count=n * (width // np.dtype(kind).itemsize)))
        at += n * width
    ids, null, key, final, lead = about
    final = final.astype(bool)
    blob = pa.Codec(_CODEC).decompress(row["d"][8:], decompressed_size=int.from_bytes(row["d"][:8], "little"), asbytes=True)
    ends = np.cumsum(np.frombuffer(row["c"], "<i8"))
    texts = [blob[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
    del blob
    codes, many = grams_of(texts, lead.reshape(n, order), final, order)
    u = codes.copy()
    u.sort()
    u = u[np.concatenate([[True], u[1:] != u[:-1]])] if len(u) else u
    value = np.empty(len(u))
    for k, p in split_buckets(bucket_of(u, buckets, order)):
        value[p] = grams[k]
    place = lookup(u, codes)
    del codes, u
    full = np.flatnonzero(many)
    score = np.zeros(n)
    score[full] = np.add.reduceat(value[place], (np.cumsum(many) - many)[full])
    del place, value
    numbers, per_text = words_of(texts)
    h, place = word_hashes(numbers)
    c = np.empty(len(h), np.int64)
    for k, p in split_buckets((h >> np.uint64(20)).astype(np.int64) % buckets):
        c[p] = words[k]
    log_c, known = np.log10(c + 0.5)[place] if len(h) else np.empty(0), (c > 0)[place] if len(h) else np.empty(0, bool)
    base = [float(log_c[w].sum()) + log_end * e for w, e in zip(per_text, final.tolist())]
    n_known = [int(known[w].sum()) + int(end_known and e) for w, e in zip(per_text, final.tolist())]
    return key.tolist(), [None if z else i for i, z in zip(ids.tolist(), null)], np.frombuffer(row["b"], np.uint8).astype(bool).tolist(), [len(w) + int(e) for w, e in zip(per_text, final.tolist())], n_known, base, score.tolist()


def lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions in sorted distinct ``keys`` of ``wanted``, which all occur; by hashing to a table, then by bisection."""
    bits = max(10, int(len(keys) * 4).bit_length())
    h = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    table = np.zeros(1 << bits, np.int32)
    table[h(keys)] = np.arange(len(keys), dtype=np.int32)
    out = np.empty(len(wanted), np.int32)
    for k in range(0, len(wanted), 1 << 20):
        w = wanted[k : k + (1 << 20)]
        p = table[h(w)]
        miss = np.flatnonzero(keys[p] != w)
        p[miss] = np.searchsorted(keys, w[miss])
        out[k : k + (1 << 20)] = p
    return out


def score_texts(docs: DataFrame, id_col: str, text_col: str, held_out: Column, order: int = ORDER, block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """``id_col``, held_out, n_tokens, n_known, train_tokens, base_score and score for every row. ``order`` is 3 to 6."""
    if not 3 <= order <= 6:
        raise ValueError("contexts have 3 to 6 symbols")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(quoted(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.encode(F.coalesce(quoted(text_col), F.lit("")), "utf-8").alias("text"))
    n_bytes, ends = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(~F.col("held"))).first()
    buckets = buckets or max(64, -(-n_bytes // BUCKET_BYTES))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sievework.llm.ppm import Pieces, block_rows, cut_text

        block = key = TaskContext.get().partitionId() << 32
        pieces = Pieces(order)

        def flush() -> Iterator[pa.RecordBatch]:
            out, wide = [], 0
            for r in block_rows(block, pieces, buckets):
                out.append(r)
                wide += sum(len(x) for x in r[3:] if x)
                if wide > 4 << 20:
                    yield _batch(out)
                    out, wide = [], 0
            yield _batch(out)

        for b in batches:
            for i, x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for a, z in cut_text(t, block_bytes):
                    pieces.add(key, i, x, t[a:z] if a or z < len(t) else t, t[max(0, a - order) : a] if a else None, z == len(t))
                    if pieces.size >= block_bytes:
                        yield from flush()
                        block, pieces = block + 1, Pieces(order)
                key += 1
        if pieces.ids:
            yield from flush()

    made = stored(rows.mapInArrow(gather, A_TABLE), "ppm-blocks")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sievework.llm.ppm import expand

        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for kind, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                keys, counts = expand(x).astype(np.int64), expand(y).astype(np.float64)
                if kind in total:
                    keys, inv = np.unique(np.concatenate([total[kind][0], keys]), return_inverse=True)
                    counts = np.bincount(inv, np.concatenate([total[kind][1], counts]), len(keys))
                total[kind] = keys, counts
        for kind, (keys, counts) in total.items():
            for k in range(0, len(keys), 100_000):
                some = keys[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), pa.array(some), pa.array(counts[k : k + 100_000].astype(np.int64))], ["kind", "p", "n"])

    sums = made.where(F.col("kind").isin(PAIRS, TRIPLES)).select("kind", "a", "b").mapInArrow(add_up, "kind int, p long, n long").groupBy("kind", "p").agg(F.sum("n").alias("n"))
    sums = sums.limit(SYMBOLS**2 + SYMBOLS**3).toArrow().sort_by("p")
    of = lambda kind: sums.filter(pa.compute.equal(sums["kind"], kind))
    pairs = np.zeros(SYMBOLS**2, np.int64)
    pairs[of(PAIRS)["p"].to_numpy()] = of(PAIRS)["n"].to_numpy()
    low = spark.sparkContext.broadcast(LowOrders(pairs.reshape(SYMBOLS, SYMBOLS), of(TRIPLES)["p"].to_numpy(), of(TRIPLES)["n"].to_numpy()))
    del sums

    def answer_grams(key: tuple, t: pa.Table) -> pa.Table:
        from sievework.llm.ppm import code_lengths, expand

        codes, counts = [expand(x) for x in t["a"].to_pylist()], [expand(x) for x in t["b"].to_pylist()]
        u, inv = np.unique(np.concatenate(codes), return_inverse=True)
        value = code_lengths(u, np.bincount(inv, np.concatenate(counts).astype(np.float64), len(u)), low.value, order).astype("<f4")
        parts = np.split(value[inv], np.cumsum([len(c) for c in codes])[:-1])
        return pa.table({"block": t["block"], "kind": pa.array([GRAMS] * len(parts), pa.int32()), "bucket": t["bucket"], "a": pa.array([p.tobytes() for p in parts], pa.binary())})

    def answer_words(key: tuple, t: pa.Table) -> pa.Table:
        from sievework.llm.ppm import expand, squeeze

        words, counts = [expand(x) for x in t["a"].to_pylist()], [expand(x).astype(np.int64) for x in t["b"].to_pylist()]
        u, inv = np.unique(np.concatenate(words), return_inverse=True)
        total = np.zeros(len(u), np.int64)
        np.add.at(total, inv, np.concatenate(counts))
        parts = np.split(total[inv], np.cumsum([len(w) for w in words])[:-1])
        n, v = int(total.sum()), int((total > 0).sum())
        return pa.table({"block": t["block"], "kind": pa.array([WORDS] * len(parts), pa.int32()), "bucket": t["bucket"], "a": pa.array([squeeze(p) for p in parts], pa.binary()), "n": pa.array([n] + [0] * (len(parts) - 1), pa.int64()), "v": pa.array([v] + [0] * (len(parts) - 1), pa.int64())})

    by_word = stored(made.where(F.col("kind") == WORDS).select("block", "bucket", "a", "b").groupBy("bucket").applyInArrow(answer_words, "block long, kind int, bucket long, a binary, n long, v long"), "ppm-words")
    sums = by_word.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n_tokens, n_words = sums[0] + ends, sums[1] + (ends > 0)
    log_end, end_known = float(np.log10(ends + 0.5)), ends > 0
    by_gram = made.where(F.col("kind") == GRAMS).select("block", "bucket", "a", "b").groupBy("bucket").applyInArrow(answer_grams, "block long, kind int, bucket long, a binary")
    none = F.lit(None).cast("binary")
    texts = made.where(F.col("kind") == TEXTS).select("block", "kind", "bucket", "a", "b", "c", "d")
    answers = by_gram.unionAll(by_word.select("block", "kind", "bucket", "a")).select("block", "kind", "bucket", "a", none.alias("b"), none.alias("c"), none.alias("d"))

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        from sievework.llm.ppm import expand, score_block

        row, grams, words = None, {}, {}
        for r in t.to_pylist():
            if r["kind"] == TEXTS:
                row = r
            elif r["kind"] == GRAMS:
                grams[r["bucket"]] = np.frombuffer(r["a"], "<f4")
            else:
                words[r["bucket"]] = expand(r["a"]).astype(np.int64)
        cols = score_block(row, grams, words, buckets, order, log_end, end_known)
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["key", "id", "held_out", "n_tokens", "n_known", "base", "score"])

    scored = texts.unionAll(answers).groupBy("block").applyInArrow(meet, "key long, id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    scored = scored.groupBy("key").agg(F.first("id").alias("id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    log_all = float(np.log10(n_tokens + 0.5 * (n_words + 1)))
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(log_all)).alias("base_score"), "score")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[] for _ in _A_SCHEMA]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _A_SCHEMA)], schema=_A_SCHEMA)
