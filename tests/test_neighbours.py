"""The index of deletions against the distance of every pair."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sievework.operators import names
from sievework.operators.neighbours import PREFIX, NeighbourIndex


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def _rests(x, d):
    out = last = {x[:PREFIX]}
    for _ in range(d):
        last = {y[:k] + y[k + 1 :] for y in last for k in range(len(y))}
        out = out | last
    return out


@settings(max_examples=400)
@given(st.text("ab", max_size=16), st.lists(st.tuples(st.sampled_from("ids"), st.integers(0, 30), st.sampled_from("abc")), max_size=2))
def test_names_within_two_edits_share_a_rest(name, edits):
    other = name
    for kind, at, c in edits:
        at = min(at, len(other))
        other = other[:at] + ("" if kind == "d" else c) + other[at + (kind != "i") :]
    assert _rests(name, 2) & _rests(other, 2)


def test_all_pairs_of_random_names(spark):
    dice = random.Random(6)
    pool = ["".join(dice.choice(["a", "b", "é", "get", "_x"]) for _ in range(dice.randrange(1, 8))) for _ in range(150)] + ["", None, "a", "a", "longname" * 30, "longname" * 30 + "x", "longnme" + "longname" * 29]
    df = spark.createDataFrame([(n, 1) for n in pool], "label string, name int")
    for d in (0, 1, 2):
        index = NeighbourIndex.build(df, "label", d)
        got = sorted(map(tuple, NeighbourIndex(spark, index.folder, d).near(df, "label").collect()))
        distinct = sorted({n for n in pool if n})
        want = sorted((a, b, k) for a in distinct for b in distinct for k in [_distance(a.encode(), b.encode())] if k <= d)
        assert got == want


def test_words_of_part_as_the_scan_has_them(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    words = part.select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("w"))
    index = NeighbourIndex.build(words, "w", 2)
    for wanted in ("anvl", "boltt", "STEE", "x", "", "ring"):
        assert index.suggest_one(wanted, 5).collect() == names.suggest(words, "w", wanted, 5, 2).collect(), wanted
    assert index.near(words, "w").count() == words.distinct().alias("a").join(words.distinct().alias("b"), F.levenshtein("a.w", "b.w") <= 2).count()
    plan = index.rows.where(F.col("key").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(key" in plan
    assert NeighbourIndex.build(words.where("false"), "w").suggest_one("a").collect() == []
