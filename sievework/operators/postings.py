"""BM25 from a stored index: texts are read once, when it is built, and queries read only postings, of which they skip most.

Tasks count their own texts, slice by slice of a batch, and write them in segments of ``SEGMENT`` texts: for each term, blocks of up to ``BLOCK`` postings with the greatest term
weight among them. Building shuffles nothing, and a frequent term has many blocks, not a long one. A query reads the heads of its terms' blocks first.
The k-th greatest block maximum of any of its terms is a score that k texts reach; a block stays unread if what it can give at most, with the maxima of the other terms in
its segment, is less. So the texts on top have all their postings, and their scores are those of a scan.

Defined results: as ``retrieve.bm25``: texts without tokens do not count, repeated rows and ids are scored one by one, a repeated term of a query counts once, scores are
ranked by 9 decimals and then by id, and only positive ones are hits. A query without known terms has none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import SEPARATOR, numbered_tokens, text_slices, tokens
from ..session import drop, new_path, stored
from ..shipping import ship_package
from .retrieve import K1, RANK_DIGITS, B, query_terms

SEGMENT, BLOCK = 4096, 64
HELD = 12_000_000  # bytes of a segment's tokens
BROADCAST_BLOCKS = 500_000
SLACK = 1e-6  # sums in another order differ by less


def _blocks(mean: float, id_type: pa.DataType):
    """(term, segment, block, n, most, ordinals, ids, tfs, dls) of a task's (id, no, tokens); ``no`` names the segments."""

    def flush(ids: pa.Array, segment: int, col: pa.Array) -> Iterator[pa.RecordBatch]:
        names, at, totals = numbered_tokens(col)
        by_name = np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)
        rank = np.empty(len(names), np.int64)
        rank[by_name] = np.arange(len(names))
        # a posting is a term and a text; those of a term are in order of texts
        posting, tf = np.unique(rank[at] * len(ids) + np.repeat(np.arange(len(ids)), totals), return_counts=True)
        term, text = posting // len(ids), (posting % len(ids)).astype(np.int32)
        tf, dl = tf.astype(np.int32), totals.astype(np.int32)[text]
        first = np.searchsorted(term, np.arange(len(names)))
        within = np.arange(len(term)) - first[term]
        starts = np.flatnonzero(within % BLOCK == 0)
        most = np.maximum.reduceat(tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean)), starts)
        ends = np.append(starts, len(term)).astype(np.int32)
        words = pa.array([names[k] for k in by_name], pa.string())
        for k in range(0, len(starts), 5000):
            here, upto = starts[k : k + 5000], ends[k : k + 5001]
            part, offsets = slice(upto[0], upto[-1]), pa.array(upto - upto[0])
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(text[part]), ids.take(pa.array(text[part])), pa.array(tf[part]), pa.array(dl[part]))]
            yield pa.RecordBatch.from_arrays(
                [words.take(pa.array(term[here])), pa.array(np.full(len(here), segment)), pa.array((within[here] // BLOCK).astype(np.int32)), pa.array(np.diff(upto)), pa.array(most[k : k + 5000]), *lists],
                ["term", "segment", "block", "n", "most", "ordinals", "ids", "tfs", "dls"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop in text_slices(b.column(2), SEGMENT, HELD):
                yield from flush(b.column(0).slice(start, stop - start).cast(id_type), b.column(1)[start].as_py(), b.column(2).slice(start, stop - start))

    return run


class Bm25Index:
    """A stored index of (id, text) rows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.blocks = spark.read.parquet(f"{folder}/blocks")
        row = spark.read.parquet(f"{folder}/stats").first()
        self.n, self.mean = row["n"], row["mean"]

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text_col: str, folder: str | None = None) -> Bm25Index:
        """Index a table; without ``folder`` in the shared one. Texts are taken apart once and their tokens stored until the blocks are made: the weights need the mean number of tokens."""
        spark = docs.sparkSession
        ship_package(spark)
        folder = folder or new_path(spark, "postings")
        words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
        held = stored(words.select("id", F.size("w").alias("dl"), F.array_join("w", SEPARATOR).alias("words")), "tokens")  # a filter on the number of tokens would look for them twice
        words = held.where("dl > 0")
        words.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("mean")).write.parquet(f"{folder}/stats")
        mean = spark.read.parquet(f"{folder}/stats").first()["mean"]
        rows = words.select("id", F.monotonically_increasing_id().alias("no"), "words")
        kind = rows.schema["id"].dataType
        from pyspark.sql.pandas.types import to_arrow_type

        made = rows.mapInArrow(_blocks(mean, to_arrow_type(kind)), f"term string, segment long, block int, n int, most double, ordinals array<int>, ids array<{kind.simpleString()}>, tfs array<int>, dls array<int>")
        made.sortWithinPartitions("term").write.parquet(f"{folder}/blocks")
        drop(held)
        return cls(spark, folder)

    def _wanted(self, queries: dict[str, str]) -> DataFrame:
        """(query, term, idf) of the terms that are known; the numbers of texts of the queries' terms come to the driver."""
        asked = {q: list(dict.fromkeys(query_terms(text))) for q, text in queries.items()}
        every = sorted({t for terms in asked.values() for t in terms})
        found = dict(self.blocks.where(F.col("term").isin(every)).groupBy("term").agg(F.sum("n")).collect()) if every else {}
        idf = {t: math.log((self.n - df + 0.5) / (df + 0.5) + 1) for t, df in found.items()}
        return self.spark.createDataFrame([(q, t, idf[t]) for q, terms in asked.items() for t in terms if t in idf], "query string, term string, idf double")

    def kept_blocks(self, queries: dict[str, str], k: int) -> DataFrame:
        """(query, term, idf, segment, block, kept) of all blocks of the queries' terms."""
        wanted = F.broadcast(self._wanted(queries))
        heads = stored(self.blocks.select("term", "segment", "block", "most").join(wanted, "term").withColumn("most", F.col("most") * F.col("idf")), "heads")
        place = F.row_number().over(W.partitionBy("query", "term").orderBy(F.desc("most")))
        reached = heads.withColumn("place", place).where(F.col("place") <= k).where(F.col("place") == k)
        least = reached.groupBy("query").agg(F.max("most").alias("least"))  # k texts score as much
        tops = heads.groupBy("query", "segment", "term").agg(F.max("most").alias("top"))
        sums = tops.groupBy("query", "segment").agg(F.sum("top").alias("sum"))
        bound = heads.join(tops, ["query", "segment", "term"]).join(sums, ["query", "segment"]).join(F.broadcast(least), "query", "left")
        return bound.select("query", "term", "idf", "segment", "block", (F.col("sum") - F.col("top") + F.col("most") >= F.coalesce("least", F.lit(0.0)) - SLACK).alias("kept"))

    def top_many(self, queries: dict[str, str], k: int) -> DataFrame:
        """(query, id, score, rank) of the best k texts for each query."""
        kept = stored(self.kept_blocks(queries, k).where("kept").drop("kept"), "kept-blocks")
        few = kept.count() <= BROADCAST_BLOCKS
        posts = self.blocks.where(F.col("term").isin([r[0] for r in kept.select("term").distinct().collect()]))
        posts = posts.join(F.broadcast(kept) if few else kept, ["term", "segment", "block"])
        each = posts.select("query", "segment", "idf", F.explode(F.arrays_zip("ordinals", "ids", "tfs", "dls")).alias("p"))
        tf, dl = F.col("p.tfs"), F.col("p.dls")
        part = F.col("idf") * tf * (K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * dl / F.lit(self.mean)))
        scores = each.groupBy("query", "segment", F.col("p.ordinals").alias("ordinal"), F.col("p.ids").alias("id")).agg(F.sum(part).alias("score")).where("score > 0")
        best = W.partitionBy("query").orderBy(F.desc(F.round("score", RANK_DIGITS)), "id")
        return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query", "id", "score", "rank")

    def top(self, query: str, k: int) -> DataFrame:
        """(id, score), best first."""
        return self.top_many({"": query}, k).orderBy("rank").select("id", "score")
