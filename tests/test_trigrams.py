"""Searches through the trigram index against full searches."""

import random
import re

import pytest
from sievework.operators import pattern, trigrams
from sievework.operators.trigrams import TrigramIndex, required

WORDS = ["alpha", "alphabet", "beta", "ALPHA", "gamma", "xyzzy", "a", "äöü", "日本語", "foo()", "bar[0]", "\\d", "aab", "aaab", "", "x.y", "t\tt"]


def _code(text):
    return int.from_bytes(text.encode(), "big")


@pytest.mark.parametrize("regex,need", [
    ("abcd", ("and", (_code("abc"), _code("bcd")))), ("abc|abd", ("or", (_code("abc"), _code("abd")))), ("ab[cd]", ("or", (_code("abc"), _code("abd")))),
    ("ab", True), ("a.c", True), ("(?i)abcd", True), ("abc|.*", True), ("ab?d", True), ("abc?d", ("or", (("and", (_code("abc"), _code("bcd"))), _code("abd")))), ("xab?c", ("or", (("and", (_code("xab"), _code("abc"))), _code("xac")))), ("(?:abc)+", _code("abc")), ("[^a]bc", True),
    ("\\x61bc", _code("abc")), ("abc\\p{L}", _code("abc")), ("日", _code("日")), ("^abc$", _code("abc")), ("(?P<n>abc)", _code("abc")), ("[a[bc]]xyz", True), ("[\\[]ab", _code("[ab")), ("a{3}", _code("aaa")), ("a{2}", True), ("[a&&b]abc", True),
])
def test_what_patterns_require(regex, need):
    assert required(regex) == need


def _meets(need, have):
    return need is True or (need in have if not isinstance(need, tuple) else (all if need[0] == "and" else any)(_meets(n, have) for n in need[1]))


def test_every_match_meets_what_its_pattern_requires():
    """Random patterns over random texts: no text that matches is ruled out; rarest trigrams and bounds hold."""
    dice = random.Random(3)

    def make(depth):
        k = dice.random()
        if depth == 0 or k < 0.35:
            return dice.choice(["a", "b", "ab", "abc", "ba", "[ab]", "[a-c]", ".", "\\w", "é", "[^a]"])
        if k < 0.6:
            return make(depth - 1) + make(depth - 1)
        if k < 0.75:
            return f"(?:{make(depth - 1)}|{make(depth - 1)})"
        return f"(?:{make(depth - 1)}){dice.choice(['*', '+', '?', '{2}', '{1,3}', '{0,2}', '+?'])}"

    texts = ["".join(dice.choice("abcé") for _ in range(dice.randrange(12))) for _ in range(400)]
    texts = sorted(set(texts))
    sets = {t: set(trigrams.distinct_trigrams(t).tolist()) for t in texts}
    counts = {}
    for s in sets.values():
        for g in s:
            counts[g] = counts.get(g, 0) + 1
    asked = 0
    for _ in range(600):
        p = make(4)
        need = required(p)
        few = trigrams.rarest(need, counts)
        asked += need is not True
        pass_ = [t for t in texts if _meets(few, sets[t])]
        assert len(pass_) <= trigrams.at_most(few, counts, len(texts))
        for t in texts:
            if re.search(p, t):
                assert _meets(need, sets[t]) and _meets(few, sets[t]), (p, t)
    assert asked > 100


def _files(spark, rows):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], "path string, text string, block long, trigram string")


def test_index_equals_full_search(spark, monkeypatch):
    dice = random.Random(1)
    rows = [(f"d{k % 3}/f{k % 50}.py", "\n".join(" ".join(dice.choice(WORDS) for _ in range(dice.randrange(4))) for _ in range(dice.randrange(5)))) for k in range(120)]
    rows += [("n", None), (None, "xyzzy alphabet"), ("e", ""), ("long", "q" * 5000 + "\nxyzzy")] + [rows[7]] * 2
    files = _files(spark, rows).repartition(4)
    for held, long in ((4_000_000, 1 << 20), (40, 100)):  # several blocks a task, long texts in pieces
        monkeypatch.setattr(trigrams, "HELD", held)
        monkeypatch.setattr(trigrams, "LONG", long)
        index = TrigramIndex.build(files)
        again = TrigramIndex(spark, index.folder)
        for p in ["xyzzy", "alpha(bet)?", "(beta|gamma) xyz", "日本", "foo\\(\\)", "bar\\[[0-9]\\]", "a+b", "^$", "(?i)alpha", "never there at all", "x.y", "q{9}"]:
            want = pattern.find_lines(pattern.lines_of(files, ["path"], "text"), p, "d1", "*/f?.py").select("path", "row", "snippet")
            got = again.find_lines(p, "d1", "*/f?.py").select("path", "row", "snippet")
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), p
            whole = pattern.find_lines(pattern.lines_of(files, ["path"], "text"), p)
            assert index.find_lines(p).count() == whole.count()


def test_few_files_are_searched(spark):
    rows = [(f"f{k}", f"common words and number{k:04d}\nmore of them") for k in range(1000)]
    index = TrigramIndex.build(_files(spark, rows))
    assert index.candidates("number0[0-4]17").count() < 100 and [r.path for r in index.find_lines("number0417").collect()] == ["f417"]
    assert index.candidates("common") is None and index.candidates(".*") is None  # everywhere, and nothing required
    assert index.candidates("zebra").count() == 0
    plan = index.postings.where("trigram = 5")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(trigram,5)" in plan
    with pytest.raises(ValueError):
        index.find_lines("(")
    empty = TrigramIndex.build(_files(spark, []))
    assert empty.find_lines("abc").collect() == [] and empty.find_lines(".").collect() == []
