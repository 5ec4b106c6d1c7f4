"""Benchmark decontamination: which test items are contained in which documents.

Containment is |S(item) & S(document)| / |S(item)| over sets of word shingles (words are runs of letters, marks and
digits, in lower case; five words, or all words of a shorter item). The search is by MinHash, partitioned by the size
of the item's set: items of 2^c to 2^(c+1)-1 shingles are represented by their k_c smallest shingle hashes,
k_c = floor((1 - threshold) * (2^(c+1) - 1)) + 1. An item contained to the threshold lacks fewer shingles than
that, so a document that holds it shares at least one of these hashes: nothing is lost, whatever the
document's length. The pairs found are then verified on the shingles themselves, as text.

All of it is DataFrame functions. A document's shingles are hashed, expanded and probed against the sketches within
one stage; only hits are shuffled. The sketches and the items' shingles are broadcast if their counted rows and bytes are within
``BROADCAST_ROWS`` and ``BROADCAST_BYTES``; a larger benchmark is joined by shuffle. A hot item or document adds rows in
proportion to its hits, which are pre-aggregated.

Defined results: null or empty texts and items without words match nothing; items of fewer than five words are sought
as one shingle of their length; repeated rows give one pair; rows that share an id but not a text are searched
apart, and the pair reports the best of them. Ids that are null are not reported.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, stored

WIDTH = 5
THRESHOLD = 0.8
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
WORD = r"[\p{L}\p{M}\p{Nd}]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _shingles(words: str, width: int, make) -> Column:
    """Array of ``make`` of the ``width`` words at each place; empty if there are fewer words."""
    n = F.size(words)
    at = F.transform(F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1))), lambda i: make(*[F.get(F.col(words), i + (k - 1)) for k in range(width)]))
    return F.when(n >= width, at).otherwise(F.slice(at, 1, 0))


def _hashed(words: str, width: int) -> Column:
    return _shingles(words, width, F.xxhash64)


def _text(words: str, width: int) -> Column:
    return _shingles(words, width, lambda *w: F.concat_ws(" ", *w))


def sketch_size(n: int, threshold: float = THRESHOLD) -> int:
    """Hashes kept for an item of n shingles: what the largest item of its size class needs."""
    top = 2 ** n.bit_length() - 1
    return math.floor(round((1 - threshold) * top, 9)) + 1


def find_items(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs with containment of at least ``threshold``: ``doc_id``, ``item_id``, shared, item_shingles, containment."""
    # round(threshold * n, 9) keeps n * threshold that is a whole number from being pushed up by binary fractions
    tests = items.select(quoted(item_id).alias("item"), _words(quoted(item_text)).alias("w")).where("item IS NOT NULL AND size(w) > 0")
    sizes = sorted({min(width, r[0]) for r in tests.select(F.least(F.size("w"), F.lit(width))).distinct().collect()})
    bare_doc = docs.select(quoted(doc_id).alias("doc"), quoted(doc_text).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL AND text <> ''")
    if not sizes:
        return bare_doc.where("false").select(F.col("doc").alias(doc_id), F.lit(None).cast(items.schema[item_id].dataType).alias(item_id), F.lit(0).cast("long").alias("shared"), F.lit(0).cast("long").alias("item_shingles"), F.lit(0.0).alias("containment"))

    def of_item(make) -> Column:
        return F.coalesce(*[F.when(F.least(F.size("w"), F.lit(width)) == n, make("w", n)) for n in sizes])

    grams = tests.select("item", F.explode(F.array_distinct(of_item(_text))).alias("s")).distinct()
    counted = grams.groupBy("item").agg(F.count("*").alias("n"))
    classes = F.floor(F.log2(F.col("n").cast("double") + 0.5)).cast("int")
    keep = F.floor(F.round(F.lit(1 - threshold) * (F.pow(F.lit(2.0), classes + 1) - 1), 9)).cast("int") + 1
    hashes = tests.select("item", F.explode(of_item(_hashed_words)).alias("h")).distinct()
    sketch = hashes.groupBy("item").agg(F.array_sort(F.collect_list("h")).alias("hs")).join(counted, "item").select("item", F.explode(F.slice("hs", F.lit(1), keep)).alias("h"))
    n_rows, n_bytes = grams.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("s") + F.octet_length(F.col("item").cast("string")) + 32), F.lit(0))).first()
    small = (lambda df: F.broadcast(df)) if n_rows <= BROADCAST_ROWS and n_bytes <= BROADCAST_BYTES else (lambda df: df)

    rows = bare_doc.select("doc", F.xxhash64("text").alias("row"), "text")
    words = rows.select("doc", "row", F.transform(_words(F.col("text")), lambda x: F.xxhash64(x)).alias("w"))
    probe = words.select("doc", "row", F.explode(F.concat(*[_hashed("w", n) for n in sizes])).alias("h"))
    found = stored(probe.join(small(sketch), "h").select("doc", "row", "item").distinct(), "candidates")

    full = rows.join(found.select("doc", "row").distinct().hint("shuffle_hash"), ["doc", "row"], "left_semi").dropDuplicates(["doc", "row"])
    texts = full.select("doc", "row", _words(F.col("text")).alias("w"))
    texts = texts.select("doc", "row", F.explode(F.array_distinct(F.concat(*[_text("w", n) for n in sizes]))).alias("s"))
    shared = texts.join(small(grams), "s").groupBy("doc", "row", "item").agg(F.count("*").alias("shared"))
    pairs = shared.join(found, ["doc", "row", "item"], "left_semi").join(small(counted), "item")
    good = pairs.where(F.col("shared") >= F.ceil(F.round(F.col("n") * F.lit(float(threshold)), 9)))
    best = good.groupBy("doc", "item").agg(F.max("shared").alias("shared"), F.max("n").alias("item_shingles"))
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment"))


def _hashed_words(words: str, width: int) -> Column:
    """Shingle hashes of an array of words, equal to those of the array of the words' hashes."""
    return _shingles(words, width, lambda *w: F.xxhash64(*[F.xxhash64(x) for x in w]))
