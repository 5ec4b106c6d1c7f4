"""The corpus pipeline: documents that are language-identified, not toxic, not repeated and not in the benchmark, packed.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of ``documents``.

- language: rows without a letter (``und``) or with a score below ``MIN_LANGUAGE_SCORE`` go. The model is trained on the
  rows that have a language. With two families of two languages, as in ``documents``, every score is 0.25 or more, so that
  only ``und`` goes: a text in a language that was not learned stays, under the nearest learned one.
- toxicity: rows scored 0.5 or more go. The model is trained on the labelled rows that are still there.
- repeats: of each component of five-word shingle sets linked at a similarity of 0.8, the row with the smallest id stays
  (of rows that share it, the smallest in the order of its columns). Rows without words or without an id stay.
- decontamination: rows that contain a benchmark item to 0.8 of its shingles go.
- packing: the pieces of all rows in sequences of 4096 tokens.

Null columns and extra columns pass through unchanged; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import decontaminate, langid, ngram_join, packing, toxicity
from sievework.llm.common import drop, quoted, stored, stored_alone, table

MIN_LANGUAGE_SCORE = 0.02


def _same(docs: DataFrame) -> list:
    return [quoted(c) for c in docs.columns]


def _new(docs: DataFrame) -> str:
    """A prefix that no column of ``docs`` begins with."""
    out = "_"
    while any(c.lower().startswith(out) for c in docs.columns):
        out += "_"
    return out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, new = langid.train(docs, "text", "lang", "doc_id"), _new(docs)
    judged = langid.identify(docs, model, "doc_id", "text", keep=[c for c in docs.columns if c != "doc_id"], prefix=new)
    return judged.where(F.col(f"{new}lang_pred") != "und").where(F.col(f"{new}score") >= MIN_LANGUAGE_SCORE).select(*_same(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, new = toxicity.train(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic"), _new(docs)
    judged = toxicity.score(docs, model, "doc_id", "text", keep=[c for c in docs.columns if c != "doc_id"], prefix=new)
    return judged.where(F.col(f"{new}predicted") == 0).select(*_same(docs))


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    links = stored_alone("links", lambda: ngram_join.link_components(docs, "doc_id", "text", width=5, num=80, den=100))
    losers = links.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(losers.hint("shuffle_hash"), "doc_id", "left_anti").select(*_same(docs))
    twice = links.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    again = kept.join(twice, "doc_id", "left_semi").select(*_same(docs))
    order = [quoted(c) for c, kind in again.dtypes if not kind.startswith(("map", "variant"))]
    new = _new(docs)
    # of rows that share an id, the smallest in the order of their columns stays
    one = again.groupBy("doc_id").agg(F.min(F.struct(*order)).alias(new)) if len(order) == len(docs.columns) else None
    one = again.dropDuplicates(["doc_id"]) if one is None else one.select(*[F.col(new)[c].alias(c) for c in docs.columns])
    return kept.join(twice, "doc_id", "left_anti").select(*_same(docs)).unionByName(one)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")
    return docs.join(found.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_anti").select(*_same(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, "doc_id", "text")


STAGES = [("language", language), ("toxicity", not_toxic), ("repeats", no_repeats), ("decontamination", decontaminated), ("packing", packed)]
#: Trained models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each one's result is a table in the shared folder."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored_alone(name, lambda: stage(spark, docs, sf_dir))  # noqa: B023
        if last is not None:
            drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
