from collections import Counter

import corpus_pipeline as P
import pytest
from sievework.llm import ngram_join, toxicity

from .conftest import EDGE, documents, prose


@pytest.fixture(scope="module")
def small(sf_dir):
    return sf_dir.replace("sf0.001", "sf0.01")


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["language", "toxicity", "repeats", "decontamination", "packing"] and P.ORACLE_SQL is None


def test_each_stage_on_its_input(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    a = P.language(spark, docs, small).cache()
    assert a.columns == docs.columns and a.count() == docs.count()
    b = P.not_toxic(spark, a, small).cache()
    left = {r.doc_id for r in b.collect()}
    plain = set("trash pathetic worthless loser idiot scum disgusting moron clown stupid".split())
    missed = [r.text for r in b.collect() if labels.get(r.doc_id) == 1]  # labelled toxic, with nothing that other toxic texts have
    assert len(missed) <= 2 and not any(plain & set(toxicity.words_of(t)) for t in missed) and sum(labels[i] == 0 and i not in left for i in labels) <= 5  # of 348; there are 51 toxic labels only
    c = P.no_repeats(spark, b, small).cache()
    comp = {r.doc_id: r.component_id for r in ngram_join.link_components(b, "doc_id", "text", 5, 80, 100).collect()}
    assert {r.doc_id for r in c.collect()} == {i for i, k in comp.items() if i == k} and c.columns == docs.columns
    d = P.decontaminated(spark, c, small).cache()
    from sievework.llm.decontaminate import find_items

    hit = {r.doc_id for r in find_items(c, spark.read.parquet(f"{small}/benchmark.parquet"), "doc_id", "text", "item_id", "text").collect()}
    assert {r.doc_id for r in d.collect()} == {r.doc_id for r in c.collect()} - hit and hit
    e = P.packed(spark, d, small)
    assert {r.doc_id for r in e.select("doc_id").distinct().collect()} == {r.doc_id for r in d.collect()}


def test_edges(spark, small, none):
    docs = documents(spark, [*EDGE, (40, prose(60)), (41, prose(200, 9)), (41, prose(200, 9))]).cache()
    kept = P.no_repeats(spark, docs, small)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(6) == 1 and 40 not in ids and ids.count(41) == 1 and {1, 2, 3, None} <= set(ids)
    lang = P.language(spark, docs, small)
    assert {1, 2, 3, 10}.isdisjoint({r.doc_id for r in lang.collect()}) and lang.columns == docs.columns
    assert P.not_toxic(spark, docs, small).columns == docs.columns and P.decontaminated(spark, docs, small).count() == docs.count()
    for _, stage in P.STAGES:
        assert stage(spark, none, small).count() == 0


def test_clashing_columns_and_ids(spark, small):
    """Columns named like those that the stages add, and rows of one id with different texts."""
    names = ["__lang_pred", "__score", "_predicted", "component_id", "a.b", "n_shingles"]
    rows = [(1, prose(60), "en"), (1, prose(60, 2), None), (1, prose(60, 2), None), (2, prose(60, 2), "en"), (None, prose(30, 3), "en"), (3, None, None)]
    docs = spark.createDataFrame([(*r, "s", None, *range(k, k + 6)) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in names))
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, docs, small)
        assert got.columns == docs.columns and set(map(tuple, got.collect())) <= set(map(tuple, docs.collect()))
    kept = Counter((r.doc_id, r.__getattr__("n_shingles")) for r in P.no_repeats(spark, docs, small).collect())
    assert kept == Counter([(1, 6), (None, 9), (3, 10)])
    assert P.packed(spark, docs, small).count() == len(rows)
