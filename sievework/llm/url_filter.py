"""URL filter: a blocked Bloom filter over listed canonical URLs, then an exact hash join on the possible hits.

A listed entry is a host and a path prefix, written canonically as ``host/path`` (``example.com/en/``). A URL
offers as lookup keys every suffix of its host (on dots) joined to every prefix of its path that has the length
of some listed path. The Bloom filter decides which of these keys may be listed; only they are expanded into rows
and joined with the list by equality, so false positives cost a join probe and never a wrong verdict.

The filter has 256-bit blocks (four 64-bit words). One hash picks the block, and one bit is set in each word.
Its size follows the list up to ``max_words``, so what every task holds is bounded; a longer list
raises the share of false positives, not the result. The list itself is broadcast only when its counted rows and
bytes are within ``BROADCAST_ROWS`` and ``BROADCAST_BYTES``; otherwise the join shuffles both sides.

Defined results: a null URL, or one without ``://``, has an empty host and an empty path and gets the default
verdict. Repeated rows are each judged. When rules overlap, the longest key wins; equal lengths go
to the longer host, then to the smaller text. An empty list gives every URL the default verdict.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, stored

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 8 << 20
WORDS_PER_BLOCK = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Columns (host, path) as defined above; the path keeps its leading ``/`` and ends before ``?`` or ``#``."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + F.lit(3), F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(raw) + F.lit(1), F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """A list of (verdict, ``host/path``) as a table: rule, verdict, rule_host, rule_path."""
    df = spark.createDataFrame([(r, v) for v, r in rules], "rule string, verdict string")
    return df.select("rule", "verdict", F.substring_index("rule", "/", 1).alias("rule_host"), F.expr("substring(rule, instr(rule, '/'))").alias("rule_path"))


def _hash(key: Column) -> Column:
    return F.xxhash64(key)


def _block(h: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(blocks - 1)).cast("int")


def _bit(h: Column, word: int) -> Column:
    return F.shiftrightunsigned(h, 6 * word).bitwiseAND(F.lit(63)).cast("int")


def build_filter(rules: DataFrame, n_rules: int, max_words: int = 1 << 17) -> list[int]:
    """The filter's words, at most ``max_words``, built by a bit-or aggregation over the list."""
    blocks = 1
    while blocks * WORDS_PER_BLOCK * 64 < 16 * max(1, n_rules) and blocks * WORDS_PER_BLOCK < max_words:
        blocks *= 2
    h = _hash(F.col("rule"))
    bits = rules.select(F.explode(F.array(*[F.struct((_block(h, blocks) * WORDS_PER_BLOCK + w).alias("word"), F.expr("1L").alias("one"), _bit(h, w).alias("bit")) for w in range(WORDS_PER_BLOCK)])).alias("x"))
    got = bits.groupBy("x.word").agg(F.bit_or(F.call_function("shiftleft", F.col("x.one"), F.col("x.bit"))).alias("bits")).collect()
    words = [0] * (blocks * WORDS_PER_BLOCK)
    for r in got:
        words[r["word"]] = r["bits"]
    return words


def may_be_listed(key: Column, words: list[int]) -> Column:
    """Whether the filter holds the key; the words travel as one constant array."""
    array = F.from_json(F.lit(json.dumps(words)), "array<bigint>")
    blocks, h = len(words) // WORDS_PER_BLOCK, _hash(key)
    out = F.lit(True)
    for w in range(WORDS_PER_BLOCK):
        word = F.element_at(array, _block(h, blocks) * WORDS_PER_BLOCK + (w + 1))
        out = out & (F.call_function("shiftrightunsigned", word, _bit(h, w)).bitwiseAND(F.lit(1)) == 1)
    return out


def filter_urls(urls: DataFrame, rules: DataFrame, id_col: str, url_col: str, default: str = "allow", max_words: int = 1 << 17) -> DataFrame:
    """Judge every row: columns ``id_col``, host, path, rule (null if none fits), verdict."""
    labels = F.size(F.split("rule_host", "[.]"))
    n_rules, size, most = rules.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("rule")), F.lit(0)), F.max(labels)).first()
    host, path = split_url(quoted(url_col))
    base = urls.select(quoted(id_col).alias("id"), host.alias("host"), path.alias("path"))
    if not n_rules:
        return base.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    lengths = sorted(r[0] for r in rules.select(F.length("rule_path")).distinct().collect())  # no more than the longest rule has characters
    words = build_filter(rules, n_rules, max_words)
    # of a host's labels, no more than the longest listed host has
    suffixes = F.expr(f"transform(sequence(greatest(1, size(split(host, '[.]')) - {most - 1}), size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, {most}), '.'))")
    prefixes = F.transform(F.filter(F.from_json(F.lit(json.dumps(lengths)), "array<int>"), lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    possible = F.when((F.col("host") != "") & (F.col("path") != ""), F.filter(keys, lambda k: may_be_listed(k, words)))
    rows = base.withColumn("n", F.monotonically_increasing_id()).select("n", "id", "host", "path", F.explode_outer(possible).alias("key"))
    rows = rows.withColumn("key", F.coalesce("key", F.concat(F.lit(" "), F.col("n").cast("string"))))  # rows without a key do not meet in one task
    listed = rules.select(F.col("rule").alias("key"), "rule", "verdict", F.length("rule_host").alias("hl")).dropDuplicates(["key"])
    if n_rules <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        listed = F.broadcast(listed)
    else:
        listed = stored(listed, "rules")  # both sides are plain shuffles then, so that a hot key's rows can be split
    found = F.when(F.col("rule").isNotNull(), F.struct((-F.length("rule")).alias("a"), (-F.col("hl")).alias("b"), "rule", "verdict"))
    # all keys of a row are in one task, so what is shuffled is one row for each URL
    best = rows.join(listed, "key", "left").groupBy("n").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("path").alias("path"), F.min(found).alias("best"))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
