"""The BM25 index against scans."""

import random

from sievework.operators import postings, retrieve
from sievework.operators.postings import Bm25Index
from sievework.session import stored as _stored


def _docs(spark, n, dice):
    words = [f"w{k}" for k in range(40)] + ["Ünï", "x_1", "rare"]
    rows = [(k, " ".join(words[min(int(dice.expovariate(0.15)), len(words) - 2)] for _ in range(dice.randrange(1, 30)))) for k in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "... !!"), (n + 3, "rare rare rare"), (n + 4, "w0 " * 500)] + [rows[0], rows[0]]
    return spark.createDataFrame([(*r, 1, "t") for r in rows], "no long, body string, n int, term string").repartition(3)


def test_index_equals_scan(spark, monkeypatch):
    for segment, block, held in ((4096, 64, 1_000_000), (16, 3, 40)):
        for name, value in (("SEGMENT", segment), ("BLOCK", block), ("HELD", held)):
            monkeypatch.setattr(postings, name, value)
        docs = _docs(spark, 300, random.Random(2))
        index = Bm25Index.build(docs, "no", "body")
        queries = {"a": "w0 w5 rare", "b": "w1", "c": "ÜNÏ w2 w2", "d": "unknown", "e": "", "f": "unknown w30 x_1"}
        got = Bm25Index(spark, index.folder).top_many(queries, 7).collect()
        for q, text in queries.items():
            want = [(r.id, round(r.score, 9)) for r in retrieve.bm25(docs, "no", "body", text, 7).collect()]
            assert [(r.id, round(r.score, 9)) for r in sorted(got, key=lambda r: r.rank) if r.query == q] == want, q
        assert [r.id for r in index.top("rare", 2).collect()] == [303] and index.top("rare", 1000).count() == 1


def test_most_blocks_are_skipped_and_frequent_terms_have_many(spark, monkeypatch):
    monkeypatch.setattr(postings, "SEGMENT", 64)
    monkeypatch.setattr(postings, "BLOCK", 8)
    rows = [(k, "common " + "other " * (k % 50) + ("common special" if k % 500 == 7 else "")) for k in range(5000)]
    index = Bm25Index.build(spark.createDataFrame(rows, "id long, text string").repartition(4), "id", "text")
    kept = {r.kept: r["count"] for r in index.kept_blocks({"q": "common special"}, 5).groupBy("kept").count().collect()}
    assert kept[False] > 3 * kept[True]
    docs = spark.createDataFrame(rows, "id long, text string")
    assert [r.id for r in index.top("common special", 5).collect()] == [r.id for r in retrieve.bm25(docs, "id", "text", "common special", 5).collect()]
    plan = index.blocks.select("term", "most").where("term = 'common'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,common)" in plan and "ids" not in plan.split("ReadSchema")[1]


def test_empty_tables(spark):
    index = Bm25Index.build(spark.createDataFrame([], "id string, text string"), "id", "text")
    assert index.n == 0 and index.top("a", 3).collect() == [] and index.top_many({}, 3).collect() == []


def test_tokens_are_looked_for_once(spark, monkeypatch):
    scanned = []
    monkeypatch.setattr(postings, "stored", lambda df, tag: scanned.append(df) or _stored(df, tag))
    monkeypatch.setattr(retrieve, "stored", lambda df, tag: scanned.append(df) or _stored(df, tag))
    docs = _docs(spark, 50, random.Random(3))
    index = Bm25Index.build(docs, "no", "body")
    retrieve.bm25(docs, "no", "body", "w0 w5", 7)
    retrieve.bm25_many(docs, "no", "body", {"a": "w0 w5"}, 7)
    for df in scanned:  # before, a filter on their number had each row's tokens found twice, and the index scanned the texts two times
        assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert len(scanned) == 3 and index.n == 54
