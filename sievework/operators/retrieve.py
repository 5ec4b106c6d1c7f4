"""Ranked retrieval: BM25, vectors, symbol scores, and their reciprocal-rank fusion."""

from __future__ import annotations

import math
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import embed_tokens, hash_similarity, split_terms, tokens
from ..semantics import DEFAULT, Semantics
from ..session import stored
from ..shipping import ship_package

K1, B = 1.2, 0.75
RRF_K = 60
LIMIT, OVERSCAN = 10, 4
STRUCTURAL_LIMIT = 10
CHANNELS = ("structural", "bm25", "vector")
#: Scores are ranked by so many decimals, so that sums added up in another order give the same ranks.
RANK_DIGITS = 9


def query_terms(query: str) -> list[str]:
    """The query's tokens, in order of appearance."""
    import regex

    return [t.lower() for t in regex.findall(r"[\p{L}\p{Nd}_]+", query.lower())]


def bm25(docs: DataFrame, id_col: str, text_col: str, query: str, k: int | None = None, semantics: Semantics = DEFAULT) -> DataFrame:
    """(id, score) of texts with a positive score, best first, ties by id.

    The query's terms are counted within each row, so nothing but three numbers per term is shuffled; the counts of the
    single scan are kept as a narrow table for scoring. Texts without tokens count neither for the number of texts nor for the mean length.
    """
    terms = query_terms(query)
    distinct = list(dict.fromkeys(terms))
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    counts = words.select("id", F.size("w").alias("dl"), *[(F.size("w") - F.size(F.array_remove("w", t))).alias(f"t{i}") for i, t in enumerate(distinct)])
    if not distinct:
        return words.where("false").select("id", F.lit(0.0).alias("score"))
    counts = stored(counts, "term-counts").where("dl > 0")  # a filter before would look for the tokens a second time
    stats = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *[F.sum((F.col(f"t{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(distinct))]).first()
    if not stats["n"]:
        return words.where("false").select("id", F.lit(0.0).alias("score"))
    score = F.lit(0.0)
    for i, t in enumerate(distinct):
        times = terms.count(t) if semantics.repeated_terms else 1
        df = stats[f"d{i}"] * times
        idf = math.log((stats["n"] - df + 0.5) / (df + 0.5) + 1)
        tf = F.col(f"t{i}").cast("double")
        score = score + F.lit(times * idf) * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(float(stats["avg"]))))
    hits = counts.where(" OR ".join(f"t{i} > 0" for i in range(len(distinct)))).select("id", score.alias("score")).where("score > 0")
    ranked = hits.orderBy(_best("score"), "id")
    return ranked.limit(k) if k else ranked


def _best(score: str) -> Column:
    return F.desc(F.round(score, RANK_DIGITS))


def bm25_many(docs: DataFrame, id_col: str, text_col: str, queries: dict[str, str], k: int) -> DataFrame:
    """(query, id, score, rank) of the top k for many queries in one plan: one scan counts the queries' terms within each text and
    keeps them as a narrow table of postings; only that is joined and shuffled by query."""
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(q, t) for q, text in queries.items() for t in dict.fromkeys(query_terms(text))], "query string, term string")
    all_terms = sorted({t for text in queries.values() for t in query_terms(text)})
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    mine = F.filter("w", lambda x: F.array_contains(F.lit(all_terms), x))
    held = stored(words.select("id", F.size("w").alias("dl"), mine.alias("w")), "query-terms").where("dl > 0")
    n, avg = held.agg(F.count("*"), F.avg("dl")).first()
    counts = F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), F.size(F.filter("w", lambda x: x == t)).alias("tf")))
    tf = held.where("size(w) > 0").select("id", "dl", F.inline(counts))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # one row per term of the queries
    idf = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.lit(avg or 1.0)))
    scores = tf.join(df, "term").withColumn("part", part).join(wanted, "term").groupBy("query", "id").agg(F.sum("part").alias("score")).where("score > 0")
    return scores.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(_best("score"), "id"))).where(F.col("rank") <= k)


def dot(a: Column | str, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_top_k(vectors: DataFrame, id_col: str, vector_col: str, query: list[float], k: int | None) -> DataFrame:
    """(id, score) by inner product, positive scores only, best first, ties by id; an exact scan."""
    hits = vectors.select(F.col(id_col).alias("id"), dot(vector_col, F.array(*[F.lit(float(x)) for x in query])).alias("score")).where("score > 0")
    ranked = hits.orderBy(_best("score"), "id")
    return ranked.limit(k) if k else ranked


def placed(hits: DataFrame, short: bool = False) -> DataFrame:
    """(id, rank) of all hits, best first, ties by id. Hits are dealt out by ranges of that order, and each range is numbered from the
    sizes of those before it; ``short`` lists (a query's top hits) are numbered in one task."""
    order = (_best("score"), F.col("id").asc())
    if short:
        return hits.select("id", F.row_number().over(W.orderBy(*order)).alias("rank"))
    ranged = stored(hits.select("id", "score").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranked")
    heads = ranged.groupBy("part").agg(F.count("*").alias("n")).withColumn("head", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(W.partitionBy("part").orderBy(*order))
    return ranged.withColumn("own", own).join(F.broadcast(heads), "part").select("id", (F.col("head") + F.col("own")).alias("rank"))


def rrf(channels: dict[str, DataFrame], limit: int | None = None, k: int = RRF_K, short: bool = False) -> DataFrame:
    """(id, score, channel) by the sum of 1 / (k + rank); ``channel`` is the first (in the dict's order) that has the id.

    An id that a list has twice counts with both ranks; one that a list lacks gets nothing from it. Whole lists are read; see ``placed`` for ``short``.
    """
    ranked = None
    for n, (name, hits) in enumerate(channels.items()):
        one = placed(hits, short).withColumns({"n": F.lit(n), "channel": F.lit(name)})
        ranked = one if ranked is None else ranked.unionAll(one)
    merged = ranked.groupBy("id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("n", "channel"))["channel"].alias("channel"))
    merged = merged.select("id", "score", "channel")
    ranked = merged.orderBy(F.desc(F.round("score", 12)), "id")
    return ranked.limit(limit) if limit else ranked


class VectorBackend(Protocol):
    """What may stand in for the hash embedding: it answers a text query over chunks with (id, score) rows."""

    def top_k(self, chunks: DataFrame, query: str, k: int) -> DataFrame: ...


class HashVectors:
    """The built-in backend: signed token hashes, an exact scan."""

    def __init__(self, dim: int = 1024):
        self.dim = dim

    def top_k(self, chunks: DataFrame, query: str, k: int) -> DataFrame:
        ship_package(chunks.sparkSession)
        q = embed_tokens(query_terms(query), self.dim).tolist()
        return chunks.select("id", hash_similarity(tokens(F.col("text")), q).alias("score")).where("score > 0").orderBy(_best("score"), "id").limit(k)


def vector_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits whose chunk is still there. The few hits go to the chunks, so that ids of all chunks are neither shuffled nor made distinct."""
    there = chunks.select("id").join(F.broadcast(hits.select("id")), "id", "left_semi").distinct()
    return hits.join(F.broadcast(there), "id", "left_semi")


def parse_channels(text: str) -> list[str]:
    """A comma list of channels; empty is all. Raises ValueError for an unknown one."""
    names = [x.strip() for x in text.split(",") if x.strip()] or list(CHANNELS)
    for x in names:
        if x not in CHANNELS:
            raise ValueError(f"unknown channel {x!r}")
    return names


def explain(chunks: DataFrame, symbols: DataFrame | None, query: str, channels: list[str] | None = None, limit: int = LIMIT, backend: VectorBackend | None = None) -> dict[str, DataFrame]:
    """Every channel's ranked hits."""
    names, wide, out = list(CHANNELS) if channels is None else channels, limit * OVERSCAN, {}
    if "structural" in names and symbols is not None:
        from .names import search

        out["structural"] = search(symbols, split_terms(query, strict=False), limit=STRUCTURAL_LIMIT).select("id", "score")
    if "bm25" in names:
        out["bm25"] = bm25(chunks, "id", "text", query, wide)
    if "vector" in names:
        found = stored((backend or HashVectors()).top_k(chunks, query, wide), "vector-hits")  # read several times below
        out["vector"] = vector_hits(found, chunks)
    return out


def hybrid(chunks: DataFrame, symbols: DataFrame | None, query: str, channels: list[str] | None = None, limit: int = LIMIT, backend: VectorBackend | None = None) -> DataFrame:
    """(id, score, channel, chunk) of the fused channels; ``chunk`` is null for hits without one."""
    names = list(CHANNELS) if channels is None else channels
    if not names:
        raise ValueError("all channels are disabled")
    chunks = stored(chunks, "chunks")  # the channels and the result read them
    fused = stored(rrf(explain(chunks, symbols, query, names, limit, backend), limit, short=True), "fused")  # read twice
    one = chunks.join(F.broadcast(fused.select("id")), "id", "left_semi").select("id", F.struct(*chunks.columns).alias("chunk")).dropDuplicates(["id"])
    return fused.join(one, "id", "left").orderBy(F.desc(F.round("score", 12)), "id")


def expand_seeds(hits: DataFrame, top: int = 3, weighted: bool = True) -> tuple[list[str], list[float] | None]:
    """The ids of the best hits as seeds of a traversal, with their scores as weights."""
    rows = hits.orderBy(_best("score"), "id").limit(top).collect()
    return [r["id"] for r in rows], [float(r["score"]) for r in rows] if weighted else None
