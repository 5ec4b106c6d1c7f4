"""Text functions: tokens, globs, patterns, byte lengths, sanitising, edit distance and hash embeddings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{Nd}_]+"
MAX_PATTERN_BYTES = 4096
SNIPPET_BYTES = 200
# Code points without a visible form that are taken out of names.
INVISIBLE = "[\\u200B-\\u200D\\uFEFF\\u2060\\u180E\\u202A-\\u202E\\u2066-\\u2069]"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, decimal digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def sanitize(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def glob_regex(pattern: str) -> str | None:
    """Anchored regular expression of a path glob, in which ``*`` and ``?`` stop at ``/``; None if it is malformed."""
    out, i, n = [], 0, len(pattern)
    quote = lambda c: "\\" + c if c in r"\.^$|()[]{}*+?-&~" else c
    while i < n:
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i >= n:
                return None
            out.append(quote(pattern[i]))
            i += 1
        elif c == "[":
            negated = i < n and pattern[i] == "^"
            i += negated
            ranges = []
            while True:
                if i >= n:
                    return None
                if pattern[i] == "]" and ranges:
                    i += 1
                    break
                ends = []
                while len(ends) < 2:
                    if i >= n or pattern[i] in "]-":
                        return None
                    if pattern[i] == "\\":
                        i += 1
                        if i >= n:
                            return None
                    ends.append(pattern[i])
                    i += 1
                    if len(ends) == 1 and i < n and pattern[i] == "-":
                        i += 1
                    else:
                        break
                ranges.append(quote(ends[0]) + ("-" + quote(ends[-1]) if len(ends) == 2 else ""))
            out.append(("[^/" if negated else "[") + "".join(ranges) + "]")
        else:
            out.append(quote(c))
    return "^(?s:" + "".join(out) + ")$"


def matches_glob(name: Column, pattern: str) -> Column:
    """Glob match; a malformed pattern matches only the text that equals it."""
    regex = glob_regex(pattern)
    return name == pattern if regex is None else name.rlike(regex)


def path_passes_glob(path: Column, pattern: str | None) -> Column:
    """Glob filter on paths; none, or a malformed one, lets everything pass."""
    regex = glob_regex(pattern) if pattern else None
    return F.lit(True) if regex is None else path.rlike(regex)


def java_pattern(pattern: str) -> str:
    """A linear-time dialect pattern as a Java one. Raises ValueError for what that dialect does not have."""
    if len(pattern.encode()) > MAX_PATTERN_BYTES:
        raise ValueError(f"a pattern has at most {MAX_PATTERN_BYTES} bytes")
    bare = re.sub(r"\\.", "..", pattern, flags=re.S)
    if re.search(r"\(\?(?:[=!>]|<[=!])", bare):
        raise ValueError("lookaround and atomic groups are not supported")
    if re.search(r"\\[1-9kGX]", re.sub(r"\\\\", "..", pattern)):
        raise ValueError("back references are not supported")
    outside = re.sub(r"\[\^?\]?[^\]]*\]", "c", bare)
    if re.search(r"(?:[*+?]|\{\d+,?\d*\})\+", outside):
        raise ValueError("possessive quantifiers are not supported")
    try:
        re.compile(re.sub(r"\\[pP](?:\{\w+\}|\w)", r"\\w", pattern).replace("(?<", "(?P<").replace(r"\z", r"\Z"))
    except re.error as e:
        raise ValueError(f"bad pattern: {e}") from None
    return pattern.replace("(?P<", "(?<")


def snippet(text: Column, most: int = SNIPPET_BYTES) -> Column:
    """At most ``most`` UTF-8 bytes; what is longer is cut (within a character, if it falls so) and marked by an ellipsis."""
    raw = F.make_valid_utf8(F.substring(F.encode(text, "utf-8"), 1, most).cast("string"))
    return F.when(F.octet_length(text) > most, F.concat(raw, F.lit("…"))).otherwise(text)


def byte_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance over UTF-8 bytes; -1 above ``most``. Bytes are compared as characters of a one-byte charset."""
    as_bytes = lambda c: F.decode(F.encode(c, "utf-8"), "iso-8859-1")
    return F.levenshtein(as_bytes(a), as_bytes(b), most)


def _fnv1a(words: list[bytes], seed: int) -> np.ndarray:
    """64-bit FNV-1a of a seed byte and each word; all words of one length step by step together."""
    out = np.empty(len(words), np.uint64)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    prime = np.uint64(0x100000001B3)
    for n in np.unique(lens):
        at = np.flatnonzero(lens == n)
        data = np.frombuffer(b"".join([words[k] for k in at]), np.uint8).reshape(len(at), n)
        h = np.full(len(at), (0xCBF29CE484222325 ^ seed) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for k in range(n):
            h = (h ^ data[:, k]) * prime
        out[at] = h
    return out


SEPARATOR = "\x1f"


def _embed(words: list[str], at: np.ndarray, owner: np.ndarray, n: int, dim: int, hashes: int) -> np.ndarray:
    """Rows of ``embed_many`` for ``n`` lists: a token is the number (``at``) of one of the distinct ``words``, and is its ``owner``'s."""
    if dim < 1 or dim & (dim - 1):
        raise ValueError("the dimension must be a power of two")
    raw = [w.encode() for w in words]
    v = np.zeros(n * dim)
    for i in range(hashes if len(at) else 0):
        h = _fnv1a(raw, i)
        cell, sign = (h & np.uint64(dim - 1)).astype(np.int64), 2.0 * (h >> np.uint64(32) & np.uint64(1)).astype(np.float64) - 1.0
        v += np.bincount(owner * dim + cell[at], sign[at], len(v))
    v = v.reshape(n, dim)
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def embed_many(lists: list[list[str]], dim: int = 1024, hashes: int = 4) -> np.ndarray:
    """Signed hash counts of each list of tokens, scaled to length 1, as rows. Distinct tokens are hashed once."""
    flat = [w for ws in lists for w in ws]
    number = {w: k for k, w in enumerate(dict.fromkeys(flat))}
    at = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    return _embed(list(number), at, np.repeat(np.arange(len(lists)), [len(ws) for ws in lists]), len(lists), dim, hashes)


#: Texts, and bytes of them, that are taken apart at once.
SLICE_TEXTS, SLICE_BYTES = 1024, 2_000_000


def text_slices(col: pa.Array, texts: int | None = None, size: int | None = None) -> Iterator[tuple[int, int]]:
    """(from, to) of slices of ``col`` with so many texts and bytes at most; a longer text is a slice of its own."""
    texts, size = texts or SLICE_TEXTS, size or SLICE_BYTES
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)), 0
    while start < len(col):
        upto = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, "right"))
        stop = min(max(upto, start + 1), start + texts)
        yield start, stop
        start = stop


def numbered_tokens(col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct tokens of texts that ``SEPARATOR`` joins, the number of each token among them, and the tokens of each text; a null or empty text has none."""
    col = pc.fill_null(col, "")
    lists = pc.split_pattern(col, SEPARATOR)
    counts = np.where(pc.equal(col, "").to_numpy(zero_copy_only=False), 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    tokens_of = lists.filter(pc.not_equal(col, "")).flatten().dictionary_encode()
    return tokens_of.dictionary.to_pylist(), tokens_of.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts


def _embed_joined(col: pa.Array, dim: int, hashes: int = 4) -> Iterator[np.ndarray]:
    """``embed_many`` of joined tokens, slice by slice, so that few tokens are held at once."""
    for start, stop in text_slices(col):
        words, at, counts = numbered_tokens(col.slice(start, stop - start))
        yield _embed(words, at, np.repeat(np.arange(stop - start), counts), stop - start, dim, hashes)


def embed_tokens(words: list[str], dim: int = 1024, hashes: int = 4) -> np.ndarray:
    return embed_many([words], dim, hashes)[0]


def hash_embedding(words: Column, dim: int = 1024) -> Column:
    """``embed_tokens`` of an array of tokens, which travel as one text. Python is needed: the hash multiplies modulo 2^64."""

    @F.arrow_udf("array<double>")
    def embed(col: pa.Array) -> pa.Array:
        made = [pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), dim).cast(pa.list_(pa.float64())) for v in _embed_joined(col, dim)]
        return pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.float64()))

    return embed(F.array_join(words, SEPARATOR))


def hash_similarity(words: Column, query: list[float]) -> Column:
    """Inner product of ``query`` with ``embed_tokens`` of an array of tokens; the vectors themselves stay in Python."""

    @F.arrow_udf("double")
    def score(col: pa.Array) -> pa.Array:
        q = np.array(query)
        return pa.array(np.concatenate([np.zeros(0), *((v * q).sum(1) for v in _embed_joined(col, len(q)))]))

    # else a filter on the score would have it computed a second time
    return score.asNondeterministic()(F.array_join(words, SEPARATOR))


def split_terms(query: str, strict: bool = True) -> list[str]:
    """Terms of a query: split at blanks, with "..." phrases. An open quote is an error, or is let pass if not strict."""
    out, cur, quoted = [], [], False
    for c in query:
        if c == '"':
            if quoted or cur:
                if cur:
                    out.append("".join(cur))
                cur = []
            quoted = not quoted
        elif c in " \t\n\r" and not quoted:
            if cur:
                out.append("".join(cur))
            cur = []
        else:
            cur.append(c)
    if quoted and strict:
        raise ValueError("the query has an open quote")
    if cur:
        out.append("".join(cur))
    return [t for t in out if t.strip()]
