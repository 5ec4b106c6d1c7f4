"""The engine's operators bound to the TPC-H-like tables, with the equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import matches_glob, path_passes_glob, sanitize, snippet, strip, tokens
from ..operators import architecture, chunks, edges, intervals, names, neighbours, pattern, postings, retrieve, traverse, tree, trees, trigrams
from ..semantics import Semantics
from ..sources import markup
from ..sources.registry import freshness

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

QUERY_TEXT = "the of and ingthe"
RE = r"th[aeiou]n"


def bound(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- retrieval

_BM25 = r"""
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}_]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
q AS (SELECT * FROM (VALUES ('the'), ('of'), ('and'), ('ingthe')) v(t)),
df AS (SELECT t, count(*) AS df FROM tf WHERE t IN (SELECT t FROM q) GROUP BY t),
bm AS (SELECT doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS s
       FROM tf JOIN df USING (t) JOIN dl USING (doc_id), st GROUP BY doc_id)
"""


@bound(f"WITH {_BM25} SELECT doc_id, round(s, 6) AS score FROM bm WHERE s > 0 ORDER BY round(s, 9) DESC, doc_id LIMIT 20")
def bm25_top(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieve.bm25(_t(spark, d, "documents"), "doc_id", "text", QUERY_TEXT, 20)
    return hits.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@bound(r"""
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}_]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
q AS (SELECT * FROM (VALUES ('q1', 'the'), ('q1', 'and'), ('q2', 'der'), ('q2', 'die'), ('q3', 'que')) v(query, t)),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
bm AS (SELECT query, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS s
       FROM q JOIN tf USING (t) JOIN df USING (t) JOIN dl USING (doc_id), st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, doc_id) AS k FROM bm WHERE s > 0)
SELECT query, doc_id, round(s, 6) AS score, k::INTEGER AS rank FROM r WHERE k <= 5
""")
def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieve.bm25_many(_t(spark, d, "documents"), "doc_id", "text", {"q1": "the and", "q2": "der die", "q3": "que"}, 5)
    return hits.select("query", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


INDEXED_TEXTS = {"q1": "the and", "q2": "der die trash", "q3": "que", "q4": "licensed general public work", "q5": "ingthe"}


@bound(r"""
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}_]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id),
st AS (SELECT count(*) AS n, avg(dl) AS a FROM dl),
q AS (SELECT query, unnest(string_split(x, ' ')) AS t FROM (VALUES ('q1', 'the and'), ('q2', 'der die trash'), ('q3', 'que'), ('q4', 'licensed general public work'), ('q5', 'ingthe')) v(query, x)),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
bm AS (SELECT query, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))) AS s
       FROM q JOIN tf USING (t) JOIN df USING (t) JOIN dl USING (doc_id), st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(s, 9) DESC, doc_id) AS k FROM bm WHERE s > 0)
SELECT query, doc_id, round(s, 6) AS score, k::INTEGER AS rank FROM r WHERE k <= 10
""")
def bm25_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The best texts by an index with block maxima; queries read no text."""
    hits = postings.Bm25Index.build(_t(spark, d, "documents"), "doc_id", "text").top_many(INDEXED_TEXTS, 10)
    return hits.select("query", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@bound(r"SELECT t AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}_]+')) AS t FROM documents) GROUP BY t")
def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.explode(tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


_VEC = """vq AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0 LIMIT 1),
vs AS (SELECT vec_id, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * e[i]::DOUBLE)) AS s FROM embeddings, vq)"""


def _vector_query(spark: SparkSession, d: str) -> list[float]:
    return _t(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


@bound(f"WITH {_VEC} SELECT vec_id, round(s, 6) AS score FROM vs WHERE s > 0 ORDER BY round(s, 9) DESC, vec_id LIMIT 25")
def vector_top(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieve.vector_top_k(_t(spark, d, "embeddings"), "vec_id", "embedding", _vector_query(spark, d), 25)
    return hits.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@bound(f"""
WITH {_BM25}, {_VEC},
a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(s, 9) DESC, doc_id) AS r FROM (SELECT * FROM bm WHERE s > 0 ORDER BY round(s, 9) DESC, doc_id LIMIT 40)),
b AS (SELECT vec_id AS id, row_number() OVER (ORDER BY round(s, 9) DESC, vec_id) AS r FROM (SELECT * FROM vs WHERE s > 0 ORDER BY round(s, 9) DESC, vec_id LIMIT 40)),
u AS (SELECT id, r, 'bm25' AS c FROM a UNION ALL SELECT id, r, 'vector' FROM b)
SELECT id AS doc_id, round(sum(1.0 / (60 + r)), 9) AS score, min(c) AS channel FROM u GROUP BY id ORDER BY round(sum(1.0::DOUBLE / (60 + r)), 12) DESC, id LIMIT 10
""")
def fused_top(spark: SparkSession, d: str) -> DataFrame:
    text = retrieve.bm25(_t(spark, d, "documents"), "doc_id", "text", QUERY_TEXT, 40)
    vec = retrieve.vector_top_k(_t(spark, d, "embeddings"), "vec_id", "embedding", _vector_query(spark, d), 40)
    return retrieve.rrf({"bm25": text, "vector": vec}, 10, short=True).select(F.col("id").alias("doc_id"), F.round("score", 9).alias("score"), "channel")


@bound()
def hash_embedding_top(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieve.HashVectors(256).top_k(docs, QUERY_TEXT, 10)


@bound()
def hybrid_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "source")
    return retrieve.hybrid(docs, None, QUERY_TEXT, ["bm25", "vector"], 5, retrieve.HashVectors(256)).select("id", "score", "channel", "chunk.source")


# --- lines and patterns

_LINES = """l0 AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS path, string_split(text, chr(10)) AS p FROM documents WHERE text <> ''),
l1 AS (SELECT doc_id, path, CASE WHEN p[len(p)] = '' THEN p[:len(p) - 1] ELSE p END AS p FROM l0),
lines AS (SELECT doc_id, path, unnest(p) AS text, unnest(range(0, len(p)))::INTEGER AS row FROM l1)"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").withColumn("path", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return pattern.lines_of(_files(spark, d), ["doc_id", "path"], "text")


@bound(f"WITH {_LINES} SELECT path, row, text FROM lines")
def lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("path", "row", "text")


@bound(f"""WITH {_LINES},
h AS (SELECT path, row, text, CASE WHEN strlen(text) > 200 THEN list_max(list_filter(range(50, 201), lambda i: strlen(substr(text, 1, i)) <= 200)) END AS n
      FROM lines WHERE regexp_matches(text, '{RE}') AND starts_with(path, 'src1') AND regexp_matches(path, '^[^/]*/e[^/]*/[^/]*$'))
SELECT path, row, CASE WHEN n IS NULL THEN text ELSE substr(text, 1, n) || CASE WHEN strlen(substr(text, 1, n)) < 200 THEN chr(65533) ELSE '' END || '…' END AS snippet FROM h""")
def regex_lines(spark: SparkSession, d: str) -> DataFrame:
    """Matching lines below a scope and a glob; a snippet that is cut within a character ends with a replacement character."""
    return pattern.find_lines(_lines(spark, d), RE, scope="src1", file_glob="*/e*/*").select("path", "row", "snippet")


INDEXED = {"license": "Released under the (MIT|BSD) Licen[cs]e", "repeated": "(er|on){3,}[a-z]*ble", "short": "^.{1,3}$"}


@bound(f"WITH {_LINES} " + " UNION ALL ".join(f"SELECT '{k}' AS pattern, path, row FROM lines WHERE regexp_matches(text, '{p}')" for k, p in INDEXED.items()))
def indexed_lines(spark: SparkSession, d: str) -> DataFrame:
    """Searches through a trigram index; the last pattern requires no trigram and searches all files."""
    index = trigrams.TrigramIndex.build(_files(spark, d).select("path", "text"))
    out = None
    for name, p in INDEXED.items():
        one = index.find_lines(p).select(F.lit(name).alias("pattern"), "path", "row")
        out = one if out is None else out.unionAll(one)
    return out


@bound("SELECT part.p_partkey, CASE WHEN strlen(p_name || ' ' || p_type || repeat(' ' || p_brand, 20)) > 200 THEN substr(p_name || ' ' || p_type || repeat(' ' || p_brand, 20), 1, 200) || '…' ELSE p_name || ' ' || p_type || repeat(' ' || p_brand, 20) END AS snippet FROM part")
def ascii_snippets(spark: SparkSession, d: str) -> DataFrame:
    long = F.concat(F.col("p_name"), F.lit(" "), F.col("p_type"), F.repeat(F.concat(F.lit(" "), "p_brand"), 20))
    return _t(spark, d, "part").select("p_partkey", snippet(long).alias("snippet"))


_SPANS = f"""{_LINES},
br AS (SELECT *, (row // 4)::INTEGER AS blk FROM lines),
spans AS (SELECT path, blk AS seq, min(row) AS a, max(row) + 1 AS b FROM br GROUP BY path, blk UNION ALL SELECT path, 100000 + blk, min(row), max(row) + 3 FROM br GROUP BY path, blk)"""


def _spans(spark: SparkSession, d: str) -> DataFrame:
    blocks = _lines(spark, d).withColumn("seq", F.expr("row DIV 4").cast("int")).groupBy("path", "seq").agg(F.min("row").alias("start_row"), (F.max("row") + 1).alias("end_row"))
    wide = blocks.select("path", F.col("seq") + 100_000, "start_row", F.col("end_row") + 2)
    return blocks.unionAll(wide).withColumns({"id": F.concat_ws("#", "path", F.col("seq").cast("string")), "kind": F.lit("FUNCTION"), "name": F.col("seq").cast("string")})


@bound(f"""WITH {_SPANS}, h AS (SELECT path, row FROM lines WHERE regexp_matches(text, '{RE}')),
m AS (SELECT h.path, h.row, s.seq, row_number() OVER (PARTITION BY h.path, h.row ORDER BY s.seq) AS k FROM h LEFT JOIN spans s ON s.path = h.path AND a <= row AND row < b)
SELECT path, row, path || '#' || seq AS id FROM m WHERE k = 1""")
def enclosing_first(spark: SparkSession, d: str) -> DataFrame:
    hit = pattern.find_lines(_lines(spark, d).select("path", "row", "text"), RE)
    return pattern.enclosing(hit, _spans(spark, d), "path", payload=["id"]).select("path", "row", "id")


@bound(f"""WITH {_SPANS}, h AS (SELECT path, row FROM lines WHERE regexp_matches(text, '{RE}')),
m AS (SELECT h.path, h.row, s.seq, row_number() OVER (PARTITION BY h.path, h.row ORDER BY b - a, s.seq) AS k FROM h LEFT JOIN spans s ON s.path = h.path AND a <= row AND row < b)
SELECT path, row, path || '#' || seq AS id FROM m WHERE k = 1""")
def enclosing_smallest(spark: SparkSession, d: str) -> DataFrame:
    hit = pattern.find_lines(_lines(spark, d).select("path", "row", "text"), RE)
    return pattern.enclosing(hit, _spans(spark, d), "path", payload=["id"], semantics=Semantics(enclosing="smallest")).select("path", "row", "id")


@bound(f"""WITH {_SPANS}, h AS (SELECT path, row FROM lines WHERE regexp_matches(text, '{RE}')),
m AS (SELECT h.path, h.row, s.seq, row_number() OVER (PARTITION BY h.path, h.row ORDER BY s.seq) AS k FROM h JOIN spans s ON s.path = h.path AND a <= row AND row < b),
g AS (SELECT path || '#' || seq AS id, count(*) AS n FROM m WHERE k = 1 GROUP BY ALL)
SELECT id, n AS match_count, 0 AS bucket, row_number() OVER (ORDER BY n DESC, id)::INTEGER AS rank FROM g ORDER BY rank LIMIT 50""")
def grouped_matches(spark: SparkSession, d: str) -> DataFrame:
    hit = pattern.find_lines(_lines(spark, d).select("path", "row", "text"), RE)
    got = pattern.group_matches(pattern.enclosing(hit, _spans(spark, d), "path", payload=["id", "kind", "name"])).limit(pattern.LIMIT)
    w = W.orderBy("bucket", F.desc("match_count"), F.desc("fan_in"), "id")
    return got.select("id", "match_count", "bucket", F.row_number().over(w).alias("rank"))


@bound(f"""WITH {_SPANS}, h AS (SELECT path, greatest(row + (row % 5) * 3 - 4, 0)::INTEGER AS a0, (greatest(row + (row % 5) * 3 - 4, 0) + row % 7 + 1)::INTEGER AS b0, row FROM lines),
m AS (SELECT h.path, h.row, s.seq, CASE WHEN a <= a0 AND b0 <= b THEN 1 WHEN a <= a0 AND a0 < b THEN 2 WHEN least(b0, b) > greatest(a0, a) THEN 3 END AS tier, a, b, a0, b0
      FROM h JOIN (SELECT path, seq, a + 1 AS a, b FROM spans) s ON s.path = h.path WHERE least(b0, b) > greatest(a0, a) OR (a <= a0 AND b0 <= b)),
k AS (SELECT *, row_number() OVER (PARTITION BY path, row ORDER BY tier, CASE WHEN tier = 3 THEN -(least(b0, b) - greatest(a0, a)) ELSE b - a END, seq) AS k FROM m)
SELECT h.path, h.row, tier, h.path || '#' || seq AS id FROM h LEFT JOIN (SELECT * FROM k WHERE k = 1) k USING (path, row)""")
def three_tier(spark: SparkSession, d: str) -> DataFrame:
    """A hunk for each line, some of them beyond the last span, some from before the first one."""
    start = F.greatest(F.col("row") + (F.col("row") % 5) * 3 - 4, F.lit(0))
    hunks = _lines(spark, d).select("path", "row", start.alias("start"), (start + F.col("row") % 7 + 1).alias("end"))
    spans = _spans(spark, d).withColumn("start_row", F.col("start_row") + 1)
    return intervals.attribute(hunks, spans, "path", ["id"]).select("path", "row", "tier", "id")


@bound("""
WITH o AS (SELECT o_custkey, (epoch(o_orderdate) // 86400)::BIGINT AS a, (epoch(o_orderdate) // 86400)::BIGINT + o_orderkey % 60 AS b FROM orders),
m AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
r AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT o_custkey, min(a) AS "start", max(b) AS "end" FROM r GROUP BY o_custkey, run
""")
def merged_intervals(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400).cast("long")
    return intervals.merge(_t(spark, d, "orders").select("o_custkey", day.alias("start"), (day + F.col("o_orderkey") % 60).alias("end")), ["o_custkey"])


@bound("""
WITH n AS (SELECT doc_id, text, length(text)::BIGINT AS n FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, text, n, unnest(range(0, greatest(0, ceil((n - 1000) / 800.0))::BIGINT + 1)) AS k FROM n)
SELECT doc_id, (k * 800)::INTEGER AS "start", least(k * 800 + 1000, n)::INTEGER AS "end", md5(substr(text, k * 800 + 1, 1000)) AS digest FROM w
""")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunks.windows(_t(spark, d, "documents"), ["doc_id"], "text").select("doc_id", "start", "end", F.md5("text").alias("digest"))


@bound("""
WITH n AS (SELECT doc_id, encode(text) AS b, strlen(text)::BIGINT AS n FROM documents WHERE length(text) > 0),
w AS (SELECT doc_id, b, n, unnest(range(0, greatest(0, ceil((n - 1000) / 800.0))::BIGINT + 1)) AS k FROM n)
SELECT doc_id, (k * 800)::INTEGER AS "start", least(k * 800 + 1000, n)::INTEGER AS "end", md5(b[k * 800 + 1 : k * 800 + 1000]) AS digest FROM w
""")
def byte_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunks.windows(_t(spark, d, "documents"), ["doc_id"], "text", in_bytes=True).select("doc_id", "start", "end", F.md5("text").alias("digest"))


# --- trees

TREE_PATTERNS = {
    "bold": "(article (h1) @title ..(p (b) @bold) @par)",
    "items": r'(ul (li (a) @first) (li (a) @second (#match? @second.attrs "[aeiou]\"?$")))',
    "either": "(body [(article) (main)] @whole (footer) @foot)",
}
# a stack for each page, one tag a step; opening tags are nodes, and a closing tag ends the innermost open element of its name
_NODES = r"""tag0 AS (SELECT page_id, p, unnest(x) AS t, unnest(range(0, len(x))) AS k0 FROM (SELECT page_id, row_number() OVER () AS p,
  [y FOR y IN regexp_extract_all(coalesce(html, ''), '(?is)<!--.*?-->|<script\b[^<>]*>.*?</script\s*>|<style\b[^<>]*>.*?</style\s*>|</?[a-z][^<>]*>[^<]*') IF NOT starts_with(y, '<!--')] AS x FROM pages)),
tag AS (SELECT page_id, p, k0 AS k, lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name, starts_with(t, '</') AS closes,
  regexp_matches(t, '(?i)^<(script|style|area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr)\b') OR regexp_matches(t, '^<[^<>]*/>') AS alone, regexp_extract(t, '^<[a-zA-Z][a-zA-Z0-9]*([^<>]*)>', 1) AS attrs FROM tag0),
walk AS (SELECT p, (-1)::BIGINT AS k, []::BIGINT[] AS open, []::VARCHAR[] AS names, NULL::BIGINT AS parent, false AS node FROM (SELECT DISTINCT p FROM tag)
  UNION ALL SELECT w.p, t.k, CASE WHEN NOT closes THEN CASE WHEN alone THEN open ELSE list_append(open, t.k) END WHEN list_contains(names, name) THEN open[:len(open) - list_position(list_reverse(names), name)] ELSE open END,
  CASE WHEN NOT closes THEN CASE WHEN alone THEN names ELSE list_append(names, name) END WHEN list_contains(names, name) THEN names[:len(names) - list_position(list_reverse(names), name)] ELSE names END,
  CASE WHEN NOT closes THEN open[-1] END, NOT closes FROM walk w JOIN tag t ON t.p = w.p AND t.k = w.k + 1),
n AS (SELECT t.page_id, t.p, t.k, t.name, t.attrs, w.parent FROM walk w JOIN tag t ON t.p = w.p AND t.k = w.k WHERE node),
up AS (SELECT p, k, parent AS anc FROM n WHERE parent IS NOT NULL UNION ALL SELECT u.p, u.k, n.parent FROM up u JOIN n ON n.p = u.p AND n.k = u.anc WHERE n.parent IS NOT NULL)"""


@bound(rf"""
WITH RECURSIVE {_NODES},
bold AS (SELECT b.p, b.k, b.parent FROM n b JOIN n q ON q.p = b.p AND q.k = b.parent AND b.name = 'b' AND q.name = 'p'),
art AS (SELECT a.p, a.k, h.k AS h FROM n a JOIN n h ON h.p = a.p AND h.parent = a.k AND a.name = 'article' AND h.name = 'h1'),
one AS (SELECT DISTINCT art.p, art.k, art.h, bold.k AS b, bold.parent AS q FROM bold JOIN up ON up.p = bold.p AND up.k = bold.parent JOIN art ON art.p = up.p AND art.k = up.anc),
link AS (SELECT i.p, i.parent AS u, i.k AS i, a.k AS a, a.attrs FROM n a JOIN n i ON i.p = a.p AND i.k = a.parent AND a.name = 'a' AND i.name = 'li' JOIN n u ON u.p = i.p AND u.k = i.parent AND u.name = 'ul'),
two AS (SELECT x.p, x.a, y.a AS b FROM link x JOIN link y ON y.p = x.p AND y.u = x.u AND y.i > x.i AND regexp_matches(trim(y.attrs), '[aeiou]"?$')),
three AS (SELECT x.p, x.k AS a, y.k AS b FROM n x JOIN n y ON y.p = x.p AND y.parent = x.parent AND y.k > x.k AND x.name IN ('article', 'main') AND y.name = 'footer' JOIN n z ON z.p = x.p AND z.k = x.parent AND z.name = 'body'),
r AS (SELECT p, 'bold' AS pattern, 'title' AS capture, h AS k FROM one UNION SELECT p, 'bold', 'bold', b FROM one UNION SELECT p, 'bold', 'par', q FROM one UNION SELECT p, 'items', 'first', a FROM two UNION SELECT p, 'items', 'second', b FROM two
  UNION SELECT p, 'either', 'whole', a FROM three UNION SELECT p, 'either', 'foot', b FROM three)
SELECT page_id, pattern, capture, k::INTEGER AS start, name AS node_type FROM r JOIN n USING (p, k)
""")
def tree_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Nested patterns with several captures over the elements of all pages."""
    nodes = markup.nodes(_t(spark, d, "pages"), "page_id", "html")
    return trees.match_all(nodes, TREE_PATTERNS, in_order=True).select("page_id", "pattern", "capture", "start", "node_type")


# --- names

@bound("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[^/]*l[^/][d-r][^/]*$')")
def glob_names(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").where(matches_glob(F.col("p_name"), "*l?[d-r]*")).select("p_partkey", "p_name")


@bound("SELECT n_name AS name, levenshtein(n_name, 'NATIN_12')::INTEGER AS distance FROM (SELECT DISTINCT n_name FROM nation) WHERE levenshtein(n_name, 'NATIN_12') <= 3 ORDER BY distance, name LIMIT 3")
def did_you_mean(spark: SparkSession, d: str) -> DataFrame:
    return names.suggest(_t(spark, d, "nation"), "n_name", "a/b.NATIN_12", distance=3)


MISSPELT = ["stupd", "morron", "licence", "thee", "würde", "ingthee", "zzzzzzzz"]


@bound(r"""
WITH w AS (SELECT name FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}_]+')) AS name FROM documents) GROUP BY name HAVING count(*) >= 20),
q AS (SELECT * FROM (VALUES ('stupd'), ('morron'), ('licence'), ('thee'), ('würde'), ('ingthee'), ('zzzzzzzz')) v(wanted)),
c AS (SELECT wanted, name, levenshtein(wanted, name)::INTEGER AS distance FROM q, w WHERE abs(strlen(wanted) - strlen(name)) <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY distance, name)::INTEGER AS rank FROM c WHERE distance <= 2)
SELECT * FROM r WHERE rank <= 5
""")
def nearest_words(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions out of the established words of all texts (used 20 times or more), through the index of deletions."""
    words = _t(spark, d, "documents").select(F.explode(tokens(F.col("text"))).alias("name")).groupBy("name").count().where("count >= 20")
    index = neighbours.NeighbourIndex.build(words, "name", 2)
    return index.suggest(spark.createDataFrame([(w,) for w in MISSPELT], "wanted string"), "wanted", 5)


@bound("""
WITH s AS (SELECT p_partkey, lower(p_name) AS n, lower(p_type) AS t, lower(p_brand) AS b FROM part),
q AS (SELECT * FROM (VALUES ('small bolt'), ('ring'), ('brand#1')) v(q)),
x AS (SELECT p_partkey, max(CASE WHEN n = q THEN 0.9 WHEN contains(n, q) THEN 0.6 + 0.1 * length(q)::DOUBLE / length(n) WHEN contains(t, q) THEN 0.4 WHEN contains(b, q) THEN 0.25 END) AS best,
      sum(CASE WHEN contains(b, q) THEN 0.15 ELSE 0 END) AS bonus FROM s, q GROUP BY p_partkey)
SELECT p_partkey, round(least(best::DOUBLE + bonus::DOUBLE, 1.0), 9) AS score FROM x WHERE best IS NOT NULL
""")
def symbol_scores(spark: SparkSession, d: str) -> DataFrame:
    score = names.symbol_score(F.col("p_name"), F.col("p_type"), F.col("p_brand"), ["Small bolt", "ring", "Brand#1"])
    return _t(spark, d, "part").select("p_partkey", F.round(score, 9).alias("score")).where("score IS NOT NULL")


@bound("""
WITH s AS (SELECT p_partkey, lower(p_name) AS n, lower(p_type) AS t, p_brand FROM part WHERE starts_with(p_brand, 'Brand#1') AND p_size < 30),
x AS (SELECT *, CASE WHEN contains(n, 'bolt') THEN 0.6 + 0.1 * 4::DOUBLE / length(n) WHEN contains(t, 'bolt') THEN 0.4 WHEN contains(lower(p_brand), 'bolt') THEN 0.25 END AS s FROM s)
SELECT p_partkey, round(s::DOUBLE, 9) AS score FROM x WHERE s IS NOT NULL ORDER BY s DESC, p_brand, p_partkey LIMIT 10
""")
def symbol_search(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("name"), F.col("p_type").alias("doc"), F.col("p_brand").alias("path"), F.when(F.col("p_size") < 30, "CLASS").otherwise("FUNCTION").alias("kind"))
    return names.search(p, ["bolt"], kinds=["class"], scope="Brand#1").select(F.col("seq").alias("p_partkey"), F.round("score", 9).alias("score"))


@bound("SELECT c_custkey, c_name || chr(8203) AS raw, c_name AS clean FROM customer")
def sanitized(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit("\u200b")).alias("raw"))
    return c.withColumn("clean", sanitize(F.col("raw")))


# --- graphs

def _relations(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    o, li = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    order, part, supplier, customer = name("o:", "l_orderkey"), name("p:", "l_partkey"), name("s:", "l_suppkey"), name("c:", "o_custkey")
    return {
        "ORDERS": o.select(customer.alias("src"), name("o:", "o_orderkey").alias("dst")),
        "PARTS": li.select(order.alias("src"), part.alias("dst")),
        "SUPPLIERS": li.select(part.alias("src"), supplier.alias("dst")),
        "SUPPLIES": li.select(supplier.alias("src"), part.alias("dst")),
        "SOLD_IN": li.select(part.alias("src"), order.alias("dst")),
        "BUYERS": o.select(name("o:", "o_orderkey").alias("src"), customer.alias("dst")),
    }


SEEDS = [("c:1", 1.0), ("c:2", 0.5), ("c:4", 0.8)]
ORDER_SEEDS = [("o:1", 0.7), ("o:2", 1.0)]
_REL_SQL = """rel_ORDERS AS (SELECT 'c:' || o_custkey AS src, 'o:' || o_orderkey AS dst FROM orders),
rel_PARTS AS (SELECT DISTINCT 'o:' || l_orderkey AS src, 'p:' || l_partkey AS dst FROM lineitem),
rel_SUPPLIERS AS (SELECT DISTINCT 'p:' || l_partkey AS src, 's:' || l_suppkey AS dst FROM lineitem),
rel_SUPPLIES AS (SELECT DISTINCT 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst FROM lineitem),
rel_SOLD_IN AS (SELECT DISTINCT 'p:' || l_partkey AS src, 'o:' || l_orderkey AS dst FROM lineitem),
rel_BUYERS AS (SELECT 'o:' || o_orderkey AS src, 'c:' || o_custkey AS dst FROM orders)"""


def _seed_sql(seeds: list[tuple[str, float]]) -> str:
    return "(VALUES " + ", ".join(f"('{s}', {n}, {w}::DOUBLE)" for n, (s, w) in enumerate(seeds)) + ") v(seed, pos, w)"


_SEED_SQL = _seed_sql(SEEDS)


def _bfs_sql(follow: list[str], depth: int, kind: str | None = None, seeds: list[tuple[str, float]] = SEEDS, limit: int = 1000) -> str:
    """Unrolled steps: hits, the best for each target, what is new, the rows within the limit, and the next frontier.

    x{t} says whether step t takes place: nothing was cut before, and no more than 5000 nodes are visited with it.
    """
    keep = f" WHERE starts_with(dst, '{kind}')" if kind else ""
    parts = [_REL_SQL, f"f0 AS (SELECT seed AS node, seed, pos, w FROM {_seed_sql(seeds)})", "seen0 AS (SELECT node AS target FROM f0)", "x0 AS (SELECT count(*) <= 5000 AS go, count(*) AS visited, 0::BIGINT AS emitted FROM f0)"]
    for t in range(depth):
        rel = follow[t % len(follow)]
        parts += [
            f"h{t} AS (SELECT dst, node, seed, pos, w, w / {t + 2}.0::DOUBLE AS score, row_number() OVER (PARTITION BY seed, node ORDER BY dst) AS e FROM f{t} JOIN rel_{rel} ON node = src WHERE (SELECT go FROM x{t}))",
            f"b{t} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY score DESC, pos, node) AS k FROM h{t} WHERE e <= {limit}) WHERE k = 1)",
            f"n{t} AS (SELECT * FROM b{t} WHERE dst NOT IN (SELECT target FROM seen{t}))",
            f"r{t} AS (SELECT *, row_number() OVER (ORDER BY score DESC, dst) AS place FROM n{t}{keep})",
            f"f{t + 1} AS (SELECT dst AS node, seed, pos, w FROM n{t})",
            f"seen{t + 1} AS (SELECT target FROM seen{t} UNION ALL SELECT dst FROM n{t})",
            f"x{t + 1} AS (SELECT go AND emitted + (SELECT count(*) FROM r{t}) <= {limit} AND visited + (SELECT count(*) FROM f{t + 1}) <= 5000 AS go, visited + (SELECT count(*) FROM f{t + 1}) AS visited, emitted + (SELECT count(*) FROM r{t}) AS emitted FROM x{t})",
        ]
    rows = " UNION ALL ".join(f"SELECT dst AS target, '{follow[t % len(follow)]}' AS edge_kind, node AS source, seed, {t + 1} AS depth, score FROM r{t} WHERE place <= {limit} - (SELECT emitted FROM x{t})" for t in range(depth))
    later = " UNION ALL ".join(f"SELECT dst AS target, score AS later FROM b{t}" for t in range(depth))
    return f"WITH {', '.join(parts)}, r AS ({rows}), l AS (SELECT target, max(later) AS later FROM ({later}) GROUP BY target) SELECT target, edge_kind, source, seed, depth, round(greatest(score, later), 9) AS score FROM r JOIN l USING (target)"


def _bfs(spark: SparkSession, d: str, follow: list[str], depth: int, kind: str | None, seeds: list[tuple[str, float]], limit: int) -> DataFrame:
    start = traverse.normalise_seeds(seeds=[s for s, _ in seeds], weights=[w for _, w in seeds])
    got = traverse.traverse(_relations(spark, d), start, follow, depth, limit, keep=F.col("dst").startswith(kind) if kind else None)
    return got.rows.select("target", "edge_kind", "source", "seed", "depth", F.round("score", 9).alias("score"))


def _put_bfs(name: str, follow: list[str], depth: int, kind: str | None = None, seeds: list[tuple[str, float]] = SEEDS, limit: int = 1000) -> None:
    QUERIES[name] = lambda spark, d: _bfs(spark, d, follow, depth, kind, seeds, limit)
    SQL[name] = _bfs_sql(follow, depth, kind, seeds, limit)


_put_bfs("traverse_depth1", ["ORDERS"], 1)
_put_bfs("traverse_depth2", ["ORDERS", "PARTS"], 2)
_put_bfs("traverse_depth3", ["ORDERS", "PARTS", "SUPPLIERS"], 3)
_put_bfs("traverse_kind_filter", ["ORDERS", "PARTS", "SUPPLIERS"], 3, "s:")
_put_bfs("traverse_cycle_follow", ["PARTS", "SOLD_IN"], 4, seeds=ORDER_SEEDS)  # the third step is PARTS again
_put_bfs("traverse_depth5", ["PARTS", "SOLD_IN", "BUYERS", "ORDERS", "PARTS"], 5, "p:", ORDER_SEEDS)  # only parts are rows, so that the walk goes on
_put_bfs("traverse_row_cap", ["ORDERS", "PARTS", "SUPPLIERS", "SUPPLIES"], 4, limit=40)


@bound(f"WITH {_REL_SQL}, f AS (SELECT seed, w FROM {_SEED_SQL}) SELECT seed, max(w / 2.0::DOUBLE) AS score FROM f JOIN rel_ORDERS ON seed = src GROUP BY seed")
def traverse_seed_scores(spark: SparkSession, d: str) -> DataFrame:
    seeds = traverse.normalise_seeds(seeds=[s for s, _ in SEEDS], weights=[w for _, w in SEEDS])
    return traverse.traverse(_relations(spark, d), seeds, ["ORDERS"], 1, 1000).seed_scores


@bound("""
WITH e AS (SELECT o_orderkey AS id, 'part' AS kind, l_partkey AS target FROM orders JOIN lineitem ON o_orderkey = l_orderkey
           UNION ALL SELECT o_orderkey, 'supplier', l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY target) AS k FROM e)
SELECT id, kind, least(count(*), 8) AS total_count, count(*) > 2 AS truncated FROM r GROUP BY id, kind
""")
def edges_per_kind(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders").join(_t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    e = o.select(F.col("o_orderkey").alias("id"), F.lit("part").alias("kind"), F.col("l_partkey").alias("target")).unionAll(o.select("o_orderkey", F.lit("supplier"), "l_suppkey"))
    return edges.cap_per_kind(e, 2, "kind", ("target",), ("id",))[1]


@bound("""
WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'renamed-' || p_partkey ELSE (SELECT min(p_name) FROM part) END AS new_name FROM part),
n AS (SELECT p_name AS new_name, count(*) AS n FROM part GROUP BY p_name)
SELECT id, new_name, coalesce(n, 0) = 0 AS safe_to_rename FROM p LEFT JOIN n USING (new_name)
""")
def rename_conflicts(spark: SparkSession, d: str) -> DataFrame:
    part = _t(spark, d, "part")
    first = part.agg(F.min("p_name")).first()[0]
    s = part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.lit("").alias("path"), F.lit("").alias("pkg"), F.lit("CLASS").alias("kind"), F.lit("").alias("summary"), F.lit(0).alias("start_row"), F.lit(0).alias("end_row"), F.lit("").alias("receiver"))
    spark_ = part.sparkSession
    none = {"call_edges": spark_.createDataFrame([], "path string, pkg string, caller_id string, caller_name string, caller_receiver string, caller_start_row int, callee_name string"), "imports": spark_.createDataFrame([], "path string, import_path string, start_row int, end_row int"), "inherits": spark_.createDataFrame([], "path string, class_name string, parent_name string")}
    renames = part.select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("renamed-"), F.col("p_partkey").cast("string"))).otherwise(F.lit(first)).alias("new_name"))
    return edges.edit_impact({"symbols": s} | none, renames).select(F.col("id").cast("long").alias("id"), "new_name", "safe_to_rename")


# --- structure

@bound("SELECT 'files' AS what, count(*) AS n FROM documents UNION ALL SELECT 'packages', count(DISTINCT source) FROM documents UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus")
def report_counts(spark: SparkSession, d: str) -> DataFrame:
    return architecture.counts(_t(spark, d, "documents").withColumn("pkg", F.col("source")), _t(spark, d, "orders").withColumn("kind", F.col("o_orderstatus")))


@bound("SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def report_languages(spark: SparkSession, d: str) -> DataFrame:
    return architecture.by_count(_t(spark, d, "documents"), "lang")


@bound("SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def report_packages(spark: SparkSession, d: str) -> DataFrame:
    return architecture.by_count(_t(spark, d, "documents"), "source", 10)


def _customer_orders(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return nodes, _t(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))


@bound("SELECT c_custkey AS id, count(DISTINCT o_orderkey) AS degree FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey ORDER BY degree DESC, id LIMIT 15")
def hotspots_out(spark: SparkSession, d: str) -> DataFrame:
    return architecture.hotspots(*_customer_orders(spark, d), top=15)


@bound("SELECT l_partkey AS id, count(DISTINCT l_orderkey) AS degree FROM lineitem GROUP BY l_partkey ORDER BY degree DESC, id LIMIT 15")
def hotspots_in(spark: SparkSession, d: str) -> DataFrame:
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return architecture.hotspots(_t(spark, d, "part").select(F.col("p_partkey").alias("id")), li, 15, Semantics(degree="in"))


@bound("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY id LIMIT 50")
def dead_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Documents without any label."""
    marks = _t(spark, d, "labels").select(F.col("doc_id").alias("src"), F.col("quality").alias("dst"))
    return architecture.dead(_t(spark, d, "documents").select(F.col("doc_id").alias("id")), marks)


_TRANS = "t AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events), e AS (SELECT src, dst FROM t WHERE dst IS NOT NULL GROUP BY src, dst HAVING count(*) >= (SELECT count(*) / 30 FROM events))"


@bound(f"""WITH RECURSIVE {_TRANS}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
SELECT a.src AS node, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src""")
def event_cycles(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    n = e.count()
    t = e.select(F.col("event_type").alias("src"), F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("dst")).where("dst IS NOT NULL")
    return traverse.strong_components(t.groupBy("src", "dst").count().where(F.col("count") >= n / 30).select("src", "dst"))


_FLOW = "SELECT c_custkey AS src, (c_custkey * c_custkey + c_nationkey * 31 + 7) % (SELECT count(*) FROM {c}) + 1 AS dst FROM {c} UNION ALL SELECT c_custkey, c_custkey - c_nationkey FROM {c} WHERE c_custkey % 5 = 0 OR c_nationkey = 0"


@bound(f"""
WITH RECURSIVE e AS ({_FLOW.format(c="customer")}), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
SELECT a.src AS node, min(a.dst) AS component FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src""")
def customer_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Cycles of a graph with an edge or two for every customer: cycles with trees that lead into them."""
    edges_ = spark.sql(_FLOW.format(c="{customer}"), customer=_t(spark, d, "customer"))
    return traverse.strong_components(edges_.select("src", "dst"))


@bound("""
WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS src, (s_nationkey * 7 + 3) % 25 AS dst FROM supplier UNION SELECT DISTINCT s_nationkey, (s_nationkey + 5) % 25 FROM supplier),
r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r
""")
def reachability(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier")
    e = s.select(F.col("s_nationkey").alias("src"), ((F.col("s_nationkey") * 7 + 3) % 25).alias("dst")).unionAll(s.select("s_nationkey", (F.col("s_nationkey") + 5) % 25))
    return traverse.reachable(e)


@bound("""
WITH n AS (SELECT 'pkg:' || lang AS id, lang AS o1, '' AS o2, (-1)::BIGINT AS o3, 'Package: ' || lang AS summary FROM documents GROUP BY lang
 UNION ALL SELECT 'file:' || lang || '/' || source, lang, source, -1, 'File: ' || source FROM documents GROUP BY lang, source
 UNION ALL SELECT 'doc:' || doc_id, lang, source, doc_id, 'Doc: ' || doc_id FROM documents),
c AS (SELECT *, strlen(id) + strlen(summary) + 256 AS cost FROM n), s AS (SELECT *, sum(cost) OVER (ORDER BY o1, o2, o3 ROWS UNBOUNDED PRECEDING) AS spent FROM c)
SELECT id, summary, cost::BIGINT AS cost, spent::BIGINT AS spent FROM s WHERE spent <= 16384
""")
def tree_within_budget(spark: SparkSession, d: str) -> DataFrame:
    t = _t(spark, d, "documents")
    top = t.select("lang").distinct().select(F.concat(F.lit("pkg:"), "lang").alias("id"), F.col("lang").alias("o1"), F.lit("").alias("o2"), F.lit(-1).cast("long").alias("o3"), F.concat(F.lit("Package: "), "lang").alias("summary"))
    mid = t.select("lang", "source").distinct().select(F.concat(F.lit("file:"), "lang", F.lit("/"), "source"), "lang", "source", F.lit(-1).cast("long"), F.concat(F.lit("File: "), "source"))
    low = t.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), "lang", "source", "doc_id", F.concat(F.lit("Doc: "), F.col("doc_id").cast("string")))
    return tree.budgeted(top.unionAll(mid).unionAll(low), ["o1", "o2", "o3"]).select("id", "summary", "cost", "spent")


@bound("SELECT max(ts) AS newest, count(*) AS rows, max(ts) <= TIMESTAMP '2100-01-01' AS fresh FROM events")
def event_freshness(spark: SparkSession, d: str) -> DataFrame:
    return freshness(_t(spark, d, "events"), "ts", "2100-01-01 00:00:00")


@bound("""
WITH s AS (SELECT n_nationkey, trim(x) AS x, row_number() OVER () AS k FROM (SELECT n_nationkey, unnest(string_split('if ' || n_name || ' {|return ' || n_name || '|}|// note|x = 1 // y', '|')) AS x FROM nation)),
c AS (SELECT n_nationkey, trim(split_part(x, '//', 1)) AS x FROM s)
SELECT n_nationkey, x AS text, CASE WHEN starts_with(x, 'if ') THEN 'if' WHEN starts_with(x, 'return') THEN 'return' WHEN ends_with(x, '{') OR ends_with(x, '}') THEN 'block' ELSE 'expr' END AS kind FROM c WHERE x <> ''
""")
def statement_kinds(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "nation").select("n_nationkey", F.explode(F.split(F.concat(F.lit("if "), "n_name", F.lit(" {|return "), "n_name", F.lit("|}|// note|x = 1 // y")), "[|]")).alias("x"))
    n = n.select("n_nationkey", strip(tree.strip_comments(F.col("x"))).alias("text")).where("text <> ''")
    return n.withColumn("kind", tree.statement_kind(F.col("text")))


@bound("SELECT s_suppkey, 'src/' || s_nationkey || '/' || s_name || '.go' AS path FROM supplier WHERE regexp_matches('src/' || s_nationkey || '/' || s_name || '.go', '^src/1[^/]*/[^/]*[.]go$')")
def path_globs(spark: SparkSession, d: str) -> DataFrame:
    s = _t(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("src/"), F.col("s_nationkey").cast("string"), F.lit("/"), "s_name", F.lit(".go")).alias("path"))
    return s.where(path_passes_glob(F.col("path"), "src/1*/*.go"))

