"""The registered queries of this subpackage: thin applications of its operators to their whole tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, html_extract, langid, licenses, media, ngram_join, packing, ppm, toxicity, url_filter, warc, whitening
from .common import crc_of_id, stored, table
from .license_texts import TEMPLATES

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
LICENSE_PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract_text(table(spark, sf_dir, "pages"), "html", ["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = stored(media.with_media(table(spark, sf_dir, "documents"), "doc_id", "text"), "media")
    return media.media_features(made, "doc_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES), "page_id", "url")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_texts(table(spark, sf_dir, "documents"), "doc_id", "text", held_out=crc_of_id("doc_id") % 5 == 1)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents"), "doc_id", "text", width=3, num=90, den=100)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", usable=crc_of_id("doc_id") % 5 != 0)
    scored = toxicity.score(docs, model, "doc_id", "text")
    return scored.select("doc_id", (crc_of_id("doc_id") % 5 == 0).alias("held_out"), "score", "predicted")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, "text", "lang", "doc_id", usable=crc_of_id("doc_id") % 4 != 2)
    found = langid.identify(docs, model, "doc_id", "text")
    return found.select("doc_id", (crc_of_id("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    ends = warc.read_chunks(spark, path, keep_data=False).where("last")
    number = lambda c: F.regexp_extract(c, r"^<urn:record:(-?\d+)>$", 1).try_cast("long")
    revisit = F.col("record_type") == "revisit"
    return ends.select(
        number("record_id").alias("page_id"),
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("end_offset")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("sha1_so_far")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"), "doc_id", "text", TEMPLATES, LICENSE_PHRASES).drop("passages")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), "text", "lang", "source")


OP3_SQL = r"""
WITH r(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
rules AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rh, substr(rule, strpos(rule, '/')) AS rp FROM r),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM rest),
u AS (SELECT row_number() OVER () AS n, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
m AS (SELECT n, rule, verdict, row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC, length(rh) DESC, rule) AS k
      FROM u JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (n)
"""


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, w, least(len(w), 3) AS k FROM w),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM k WHERE k > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * i >= 90 * (na.n + nb.n - i)),
r AS (SELECT a AS doc_id, a AS c FROM (SELECT DISTINCT a FROM e) UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT k.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, k.doc_id) AS component_id
FROM k LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
OP7_SQL = r"""
WITH it AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}]+') AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), 5) AS k FROM it WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM i)),
n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id),
dt AS (SELECT doc_id, md5(text) AS m, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}]+') AS w FROM documents WHERE text <> ''),
d AS (SELECT DISTINCT doc_id, m, array_to_string(w[p:p + k - 1], ' ') AS s
      FROM (SELECT doc_id, m, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM dt, (SELECT DISTINCT k FROM i))),
c AS (SELECT doc_id, m, item_id, count(*) AS shared FROM d JOIN s USING (s) GROUP BY ALL)
SELECT doc_id, item_id, max(shared) AS shared, any_value(n) AS item_shingles, max(shared) / any_value(n) AS containment
FROM c JOIN n USING (item_id) WHERE shared >= ceil(round(n * 0.8, 9)) GROUP BY doc_id, item_id
"""
OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS b, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS r FROM p WHERE b >= 1000 GROUP BY d)
SELECT page_id, b AS payload_bytes, d AS payload_digest, CASE WHEN r <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN r <> page_id THEN r END AS refers_to
FROM p LEFT JOIN m USING (d)
"""


def _license_sql() -> str:
    """Templates as regular expressions over the words, each after a space; a passage ends before a space or the end."""

    def expression(template: str) -> str:
        out = ""
        for part in re.findall(r"<<.*?>>|[^<]+", template):
            plain = lambda t: "".join(" " + w for w in re.findall("[a-z0-9]+", t.lower()))
            if part == "<<beginOptional>>":
                out += "(?:"
            elif part == "<<endOptional>>":
                out += ")?"
            elif part.startswith("<<var"):
                out += "(?: [^ ]+){%s,%s}" % tuple(re.findall(r"\d+", part))
            elif part.startswith("<<either;"):
                out += f"(?:{'|'.join(map(plain, part[9:-2].split('|')))})"
            else:
                out += plain(part)
        return out + "( |$)"

    own = ", ".join(f"CASE WHEN regexp_matches(t, '{expression(text)}') THEN '{label}' END" for label, text in TEMPLATES)
    places = "list_concat({})".format(", ".join("[p FOR p IN range(0, len(w)) IF {}]".format(" AND ".join(f"w[p + {k}] = '{x}'" for k, x in enumerate(text.split(), 1))) for _, text in LICENSE_PHRASES))
    base = ", ".join(f"CASE WHEN contains(t || ' ', ' {text} ') THEN '{label}' END" for label, text in LICENSE_PHRASES)
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc_id, w, CASE WHEN len(w) > 0 THEN ' ' || array_to_string(w, ' ') ELSE '' END AS t FROM w),
f AS (SELECT doc_id, len(w) AS n_words, {places} AS p, [x FOR x IN [{base}] IF x IS NOT NULL] AS b, [x FOR x IN [{own}] IF x IS NOT NULL] AS o FROM t)
SELECT doc_id, n_words, len(p) AS n_base, list_min(p) AS first_word, list_max(p) AS last_word, array_to_string(list_sort(list_distinct(b)), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(b, o))), ',') AS labels, CASE WHEN len(o) > 0 THEN 1.0 WHEN len(b) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM f
"""


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS n, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT n, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT n) >= 30),
v AS (SELECT lang, count(*) AS v, sum(c) AS total FROM k GROUP BY lang),
u AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(c) AS total FROM u GROUP BY ALL) USING (lang, source)),
s AS (SELECT lang, source, term, coalesce(u.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(u.c, 0) + 5)) // (g.total + 5 * v) AS p, 1 + (1000000000::HUGEINT * (k.c + 5)) // (v.total + 5 * v) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN u USING (lang, source, term)),
f AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
      LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE c > 0 AND p > q),
n AS (SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM r)
SELECT * FROM n WHERE part = 'pair' OR rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": OP3_SQL, "op6_ngram_join": OP6_SQL, "op7_decontaminate": OP7_SQL, "op10_warc": OP10_SQL, "op11_licenses": _license_sql(), "op13_divergence": OP13_SQL}
