"""Source divergence audit: how far the word use of each source lies from the other sources of its language.

Terms are runs of letters (ASCII ones in lower case) and of all characters beyond ASCII. A language keeps the terms that at least
``least_docs`` of its documents have. A source gives a kept term the share p = 1 + floor(10^9 (c + 5) / (N + 5 V)), where c counts the
term there, N all kept terms there and V is the number of kept terms. Part ``pair`` sums |p - q| over all kept terms for two
sources of a language; part ``term`` ranks the terms that a source uses more than its language does.

The work is cut into shards by a hash of language and term. Tasks count their documents' terms into partial rows
(``HELD`` of them at a time), which go to the shards; each shard adds them up in DuckDB and gives one row per kept term with its
counts by source. Spark adds up N and V. A second pass over the shards computes the shares, partial sums for the pairs of sources,
and the leading terms; Spark adds the partial sums and ranks. A shard's memory holds its distinct (source, term) counts, which
``SHARD_ROWS`` bounds by a count of all; a frequent term has a row per source and task only, so no shard is hot. Where a language has more than
``BLOCK`` sources, a shard's pairs are dealt out by blocks of their first source.

Defined results: null text, language or source count as ''. Documents without terms still make their group occur. Repeated rows
count as often as they occur; ids are not read. A language that keeps no term has pairs of value 0 and no terms. A source that is alone in its
language has no pairs. An empty table gives no rows. Equal values are ranked by item, in the order of UTF-8 bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import quoted, small_batches, stored

LEAST_DOCS, TOP = 30, 50
HELD = 150_000
SHARD_ROWS = 400_000
BLOCK_ROWS = 200_000
BLOCK = 256
PIECE = 1 << 20
#: Bytes of terms stay, in lower case; all others divide terms.
TERM_BYTES = bytes(c if c >= 0x80 else c | 0x20 if chr(c).isalpha() else 0x20 for c in range(256))
PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
DUCK = {"threads": 1, "memory_limit": "600MB", "temp_directory": ""}


def terms_of(text: str) -> Counter:
    """The terms of a text with their counts; long texts are counted in pieces that end between terms."""
    data = text.encode("utf-8", "surrogatepass").translate(TERM_BYTES)
    if len(data) <= PIECE:
        return Counter(data.split())
    out, at = Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        out.update(data[at:end].split())
        at = end
    return out


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language, source and term of a task's documents, and a row without term for each group."""
    groups: dict[tuple[str, str], dict[bytes, list[int]]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in groups.items():
            names, counts = [None, *(t.decode("utf-8", "replace") for t in terms)], [[0, 0], *terms.values()]
            for at in range(0, len(names), 50_000):
                part = counts[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(names[at : at + 50_000], pa.string()), pa.array([c[0] for c in part]), pa.array([c[1] for c in part])], schema=PARTIAL)
        groups.clear()

    for b in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in b.columns)):
            mine = groups.setdefault((lang, source), {})
            before = len(mine)
            for term, n in terms_of(text).items():
                c = mine.get(term)
                if c is None:
                    mine[term] = [n, 1]
                else:
                    c[0] += n
                    c[1] += 1
            size += len(mine) - before + 1
            if size >= HELD:
                yield from flush()
                size = 0
    yield from flush()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together, so that SQL runs over many rows at a time."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= BLOCK_ROWS:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _add_up(least_docs: int):
    """Of a shard: one row per kept term, with its counts by source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config=DUCK) as con:
            con.execute("CREATE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
            rows = limit = 0
            for block in _blocks(batches):
                con.register("part", block)
                con.execute("INSERT INTO held SELECT lang, source, term, sum(n), sum(docs) FROM part GROUP BY ALL")
                con.unregister("part")
                rows += block.num_rows
                if rows > 2 * max(limit, SHARD_ROWS):  # what is held is added up again and again, so that it stays near its distinct rows
                    con.execute("CREATE TABLE less AS SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL")
                    con.execute("DROP TABLE held; ALTER TABLE less RENAME TO held")
                    rows = limit = con.execute("SELECT count(*) FROM held").fetchall()[0][0]
            kept = con.sql(
                "SELECT lang, term, list(source ORDER BY source) AS sources, list(n ORDER BY source) AS counts FROM "
                f"(SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL) GROUP BY lang, term HAVING sum(docs) >= {int(least_docs)}"
            )
            yield from kept.to_arrow_reader(10_000)

    return run


# shares of every source (and, with no source, of the language) for every kept term of the shard; sources are numbered by group
_SHARES = """
CREATE TABLE groups AS SELECT * FROM given_groups;
CREATE TABLE terms AS SELECT lang, term, sources, counts FROM given_terms;
CREATE TABLE used AS SELECT t.lang, t.term, g.source, n FROM (SELECT lang, term, unnest(sources) AS source, unnest(counts) AS n FROM terms) t JOIN groups g ON g.lang = t.lang AND g.source = t.source;
CREATE TABLE shares AS SELECT t.lang, t.term, g.id, g.source, coalesce(u.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 5)) // (g.total + 5 * g.kept))::BIGINT AS p
  FROM terms t JOIN groups g ON g.lang = t.lang LEFT JOIN used u ON u.lang = t.lang AND u.term = t.term AND u.source = g.source
"""
_PAIRS = """
SELECT lang, a, b, sum(value)::BIGINT AS value FROM (
  SELECT x.lang, x.source AS a, y.source AS b, abs(x.p - y.p) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.id < y.id WHERE x.id // {block} = {k}
  UNION ALL SELECT x.lang, x.source, y.source, 0 FROM groups x JOIN groups y ON x.lang = y.lang AND x.id < y.id WHERE x.id // {block} = {k} AND {first}
) GROUP BY ALL
"""
_TERMS = """
SELECT lang, source AS a, term AS b, value FROM (
  SELECT s.lang, s.source, s.term, s.p - q AS value, row_number() OVER (PARTITION BY s.lang, s.source ORDER BY s.p - q DESC, s.term) AS k
  FROM shares s JOIN (SELECT u.lang, u.term, (1 + (1000000000::HUGEINT * (sum(u.n) + 5)) // (l.total + 5 * l.kept))::BIGINT AS q
                      FROM shares u JOIN (SELECT lang, sum(total) AS total, max(kept) AS kept FROM groups GROUP BY lang) l ON l.lang = u.lang GROUP BY u.lang, u.term, l.total, l.kept) w
    ON w.lang = s.lang AND w.term = s.term
  WHERE s.n > 0 AND s.p > q AND s.id // {block} = {k}
) WHERE k <= {top}
"""


def _compare(top: int):
    """Of a shard and a block of sources: partial sums for pairs (the smaller source first) and the leading terms."""

    def run(key, terms: pa.Table, groups: pa.Table) -> pa.Table:
        import duckdb

        shard, k = key[0].as_py(), key[1].as_py()
        with duckdb.connect(config=DUCK) as con:
            con.register("given_terms", terms)
            con.register("given_groups", groups)
            con.execute(_SHARES)
            of = {"block": BLOCK, "k": k, "first": str(shard == 0).lower(), "top": top}
            found = [(part, con.sql(sql.format(**of)).to_arrow_table()) for part, sql in (("pair", _PAIRS), ("term", _TERMS))]
        return pa.concat_tables([t.select(["lang", "a", "b", "value"]).add_column(0, "part", pa.array([part] * t.num_rows, pa.string())) for part, t in found])

    return run


def audit(docs: DataFrame, text_col: str, lang_col: str, source_col: str, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value long, rank int (from 1, per group and part)."""
    spark = docs.sparkSession
    small_batches(spark)
    plain = [F.coalesce(quoted(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    partial = stored(docs.select(*plain).mapInArrow(_partial, "lang string, source string, term string, n long, docs long"), "partial-counts")
    groups = partial.where("term IS NULL").select("lang", "source").distinct()
    counted = partial.where("term IS NOT NULL")
    shards = max(1, -(-counted.count() // SHARD_ROWS))
    kept = stored(counted.repartition(shards, "lang", "term").mapInArrow(_add_up(least_docs), "lang string, term string, sources array<string>, counts array<long>"), "kept-terms")

    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("c")).groupBy("lang", F.col("c.sources").alias("source")).agg(F.sum("c.counts").alias("total"))
    numbered = groups.withColumn("id", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
    full = numbered.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", F.col("id").cast("long"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"))
    full = stored(full, "groups")
    # a shard's table of shares has a row for every kept term and every source of its language
    per_lang = full.groupBy("lang").agg(F.count("*").alias("sources"), F.max("kept").alias("kept"))
    widest, dense = per_lang.agg(F.coalesce(F.max("sources"), F.lit(0)), F.coalesce(F.sum(F.col("sources") * F.col("kept")), F.lit(0))).first()
    shards, blocks = max(1, -(-dense // SHARD_ROWS)), max(1, -(-widest // BLOCK))
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    left = kept.select(F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int").alias("shard"), each_block, "lang", "term", "sources", "counts")
    right = full.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).select("*", each_block)
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_compare(top), "part string, lang string, a string, b string, value long")
    found = stored(found, "shard-results")

    pairs = found.where("part = 'pair'").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    two = [F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")]
    both = pairs.select("lang", "value", F.explode(F.array(*two)).alias("x"))
    of_pairs = both.select("lang", F.col("x.source").alias("source"), F.lit("pair").alias("part"), F.col("x.item").alias("item"), "value")
    of_terms = found.where("part = 'term'").select("lang", F.col("a").alias("source"), "part", F.col("b").alias("item"), "value")
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = of_pairs.unionAll(of_terms).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
