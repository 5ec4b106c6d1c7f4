"""License scans, whitening and the divergence audit against brute force, with nulls, empty, long and repeated rows, and empty tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from sievework.llm import divergence, license_texts, licenses, queries, whitening

from .conftest import documents, prose

# 11: licenses

TEMPLATES = [
    ("a", "<<beginOptional>>The<<endOptional>> red fox <<var;words=1..3>> barks"),
    ("b", "one <<beginOptional>>two <<beginOptional>>three<<endOptional>><<endOptional>> four <<either;five|six seven>> eight"),
    ("c", "x <<var;words=0..2>> x y"),
    ("nothing", "<<var;words=1..3>>"),
]
PHRASES = [("a", "red fox"), ("p", "Four five")]
PATTERNS = {"a": r" red fox(?: \S+){1,3} barks(?= |$)", "b": r" one(?: two(?: three)?)? four(?: five| six seven) eight(?= |$)", "c": r" x(?: \S+){0,2} x y(?= |$)"}


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def _scan(text):
    """By regular expressions over the words, tried at every word: (label, start, words) of the shortest passage for each end, and the phrases' places."""
    w = _words(text)
    found = {}
    for label, pattern in PATTERNS.items():
        for start in range(len(w)):
            for end in range(start + 1, min(len(w), start + 12) + 1):
                if re.fullmatch(pattern, "".join(" " + x for x in w[start:end])):
                    found[label, end] = max(found.get((label, end), -1), start)
    places = [(k, i) for k, (_, p) in enumerate(PHRASES) for i in range(len(w)) if w[i : i + len(p.split())] == p.lower().split()]
    return len(w), sorted(places), sorted((label, start, end - start) for (label, end), start in found.items())


def test_licenses_equal_brute_force_on_random_words(monkeypatch):
    dice = random.Random(5)
    words = "one two three four five six seven eight red fox the barks x y z".split()
    texts = [" ".join(dice.choice(words[dice.randrange(2) * 8 :]) for _ in range(dice.randrange(60))) for _ in range(400)]
    texts += ["one two three four six seven eight", "The red-fox: a b c BARKS! red fox barks", "x x y x a b x y x a b c x y", None, "", "...", "Éx x y x x y ſ"]
    for piece, states in ((1 << 20, 4000), (7, 3)):  # long texts in pieces, and an automaton that forgets
        monkeypatch.setattr(licenses, "PIECE", piece)
        monkeypatch.setattr(licenses, "STATES", states)
        s = licenses.Scanner(TEMPLATES, PHRASES)
        for t in texts:
            n, places, passages = s.scan(t)
            assert (n, sorted(places), sorted((s.labels[k], a, b) for k, a, b in passages)) == _scan(t), t


def test_license_markup_is_checked():
    for bad in ("a <<beginOptional>> b", "a <<endOptional>>", "<<var;words=3..1>> a", "<<var>>", "<<bold>> a", "<<either>> a"):
        with pytest.raises(ValueError):
            licenses.parse(bad)
    assert licenses.parse("A < b") == [b"a", b"b"]


def _fill(template, dice):
    """The template's wording with optional regions in or out, and replaceable ones filled."""
    out = re.sub(r"<<var;words=(\d+)\.\.(\d+)>>", lambda m: " ".join(f"name{k}" for k in range(dice.randint(int(m[1]), int(m[2])))), template)
    out = re.sub(r"<<either;([^>]*)>>", lambda m: dice.choice(m[1].split("|")), out)
    while "<<beginOptional>>" in out:
        out = re.sub(r"<<beginOptional>>((?:(?!<<).)*)<<endOptional>>", lambda m: m[1] if dice.random() < 0.5 else "", out, flags=re.S)
    return out


def test_license_templates_accept_their_wordings_and_nothing_that_lacks_a_word():
    dice, s = random.Random(1), licenses.Scanner(license_texts.TEMPLATES, [])
    for k, (label, template) in enumerate(license_texts.TEMPLATES):
        for _ in range(5):
            text = _fill(template, dice)
            assert k in {t for t, _, _ in s.scan(f"before it. {text} after it")[2]}, label
        must = re.sub(r"<<beginOptional>>.*?<<endOptional>>|<<var[^>]*>>|<<either[^>]*>>", " | ", template, flags=re.S)
        whole = _fill(template, dice)
        for part in must.split("|"):
            for word in re.findall("[A-Za-z]{9,}", part):
                if whole.count(word) == 1:
                    assert k not in {t for t, _, _ in s.scan(whole.replace(word, word + "x"))[2]}, (label, word)


def test_license_frame(spark, edge, none):
    from .conftest import EDGE

    extra = [(20, "THE RED FOX, which is old, barks."), (21, "red fox red fox"), (22, "one four five eight " * 3), (23, "four five")]
    docs = documents(spark, EDGE + extra)
    got = licenses.find_licenses(docs, "doc_id", "text", TEMPLATES, PHRASES).collect()
    assert len(got) == len(EDGE) + len(extra)
    want = defaultdict(list)
    for i, t in EDGE + extra:
        n, places, passages = _scan(t)
        base, own = {PHRASES[k][0] for k, _ in places}, {x for x, _, _ in passages}
        starts = [p for _, p in places]
        want[i].append((n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), 1.0 if own else 0.5 if base else 0.0, passages))
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((*r[1:8], sorted(map(tuple, r.passages))))
    assert have == want
    assert licenses.find_licenses(none, "doc_id", "text", TEMPLATES, PHRASES).collect() == []
    assert licenses.find_licenses(none.select("id", F.lit("a").alias("n_words")), "id", "n_words", [], []).columns[0] == "id"


# 12: whitening


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n long, `odd name` string")


def _whitened(vectors, components=32):
    """(n, deviations, whitened up to sign, explained) with numpy and Python's integers."""
    x = [[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    dev = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    z = np.array([[(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, dev, z @ u / np.sqrt(e), e / np.trace(z.T @ z / n)


@pytest.mark.parametrize("parts", [1, 7])
def test_whitening_equals_numpy(spark, parts):
    dice = np.random.default_rng(3)
    v = (dice.normal(size=(300, 12)) * np.linspace(0.2, 3, 12) + 5).astype(np.float32).tolist()
    v += v[:3]
    bad = [None, [None] + [1.0] * 11, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [float("-inf")] + [0.0] * 11, [1.0] * 5, []]
    rows = [(i, x, 0, 9, "k") for i, x in enumerate(v)] + [(1000 + i, x, None, None, None) for i, x in enumerate(bad)]
    got = whitening.whiten(_vectors(spark, rows).repartition(parts), "vec_id", "embedding", components=8).collect()
    n, dev, w, share = _whitened(v, 8)
    assert len(got) == 8 * len(v) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    have = np.zeros((len(v), 8))
    for r in got:
        assert r.deviation == dev[r.vec_id] and abs(r.explained / share[r.component - 1] - 1) < 1e-9
        have[r.vec_id, r.component - 1] = r.whitened
    sign = np.sign((have * w).sum(axis=0))
    assert np.abs(have * sign - w).max() < 1e-8


def test_whitening_of_degenerate_tables(spark):
    one = lambda rows, **k: whitening.whiten(_vectors(spark, [(i, v, 0, 0, "") for i, v in enumerate(rows)]), "vec_id", "embedding", **k).collect()
    assert one([]) == [] and one([None, [None]]) == [] and one([[], []]) == []
    alone = one([[1.0, 2.0, 3.0]])
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(k, 1, 0, 0.0, 0.0, 0.0) for k in (1, 2, 3)]
    flat = one([[1.0, 5.0], [2.0, 5.0], [4.0, 5.0]])  # the second component has no variance
    assert [r.whitened for r in flat if r.component == 2] == [0.0] * 3 and abs(sum(r.whitened**2 for r in flat if r.component == 1) / 3 - 1) < 1e-12
    assert {r.explained for r in flat if r.component == 1} == {1.0}
    big = one([[3e38, 0.0], [-3e38, 1.0]])
    assert all(r.deviation is None for r in big) and len(big) == 4
    ragged = one([[1.0, 2.0], [2.0, 1.0], [1.0, 2.0, 3.0], [3.0, 2.0, 1.0]])  # equally frequent lengths: the greater
    assert sorted({r.vec_id for r in ragged}) == [2, 3] and {r.n for r in ragged} == {2}


def test_whitening_exact_sums_of_large_entries():
    rows = np.array([[2.0**61, 1.0], [2.0**61, 2.0], [2.0**61, -4.0]])
    assert whitening.exact_sums(rows) == [3 * 2**61, -1]
    a, b = whitening.moments(rows[:1]), whitening.moments(rows[1:])
    assert whitening.merge(a, b).sums == [3 * 2**61, -1] and whitening.merge(None, a) is a and whitening.merge(a, None) is a


def test_moments_merge_like_one_block():
    rows = np.random.default_rng(0).normal(1000, 1, (999, 6))
    whole, total = whitening.moments(rows), None
    for at in (0, 1, 40, 41, 700):
        total = whitening.merge(total, whitening.moments(rows[at : {0: 1, 1: 40, 40: 41, 41: 700, 700: 999}[at]]))
    assert total.n == 999 and np.allclose(total.mean, whole.mean, rtol=1e-14) and np.allclose(total.scatter, whole.scatter, rtol=1e-10, atol=1e-8)


def test_whitening_query(spark, sf_dir):
    got = queries.op12_whitening(spark, sf_dir)
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    n, dev, w, share = _whitened([r.embedding for r in rows])
    by = {r.vec_id: k for k, r in enumerate(rows)}
    have = np.zeros(w.shape)
    for r in got.collect():
        assert (r.n, r.deviation) == (n, dev[by[r.vec_id]]) and r.identity_error <= 1e-4 and abs(r.explained / share[r.component - 1] - 1) < 1e-4
        have[by[r.vec_id], r.component - 1] = r.whitened
    assert np.abs(have * np.sign((have * w).sum(axis=0)) - w).max() < 1e-6


# 13: divergence


def _audit(rows, least, top):
    """rows: (text, lang, source)."""
    docs, counts, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        for t in found:
            counts[lang, source, t] += 1
        docs.update((lang, t) for t in set(found))
    out = []
    for lang in {x for x, _ in groups}:
        kept = sorted((t for (x, t), n in docs.items() if x == lang and n >= least), key=str.encode)
        sources = sorted(s for x, s in groups if x == lang)
        share = lambda of: {t: 1 + 10**9 * (sum(counts[lang, s, t] for s in of) + 5) // (sum(counts[lang, s, u] for s in of for u in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share([s]) for s in sources}, share(sources)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            for part, ranked, most in (("pair", pairs, None), ("term", terms, top)):
                ranked.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked[:most], 1)]
    return sorted(out)


def _table(spark, rows):
    return spark.createDataFrame([(i, *r, 1, "x", 2, "y") for i, r in enumerate(rows)], "doc_id long, body string, lang string, source string, n long, term string, value long, `odd name` string")


@pytest.mark.parametrize("small", [False, True])
def test_divergence_equals_brute_force(spark, monkeypatch, small):
    dice = random.Random(2)
    words = [w + x for w in "ab ba éa ca da ea fa ga ha ia ja".split() for x in ("", "x", "é", "漢")]
    rows = []
    for k in range(240):
        lang, source = ("en", None, "de", "")[k % 4], f"s{0 if dice.random() < 0.4 else dice.randrange(9)}" if k % 7 else None
        rows.append((" ".join(dice.choice(words).upper() if dice.random() < 0.3 else dice.choice(words[: 5 + 4 * len(source or "")]) for _ in range(dice.randrange(25))) + "-9_a", lang, source))
    rows += [(None, "en", "silent"), ("", "xx", "one"), ("1 2 3", "xx", "two"), ("rare", "xx", None), ("alone alone alone " * 9, "yy", "only"), (prose(30_000), "en", "s0"), ("A" * 50_000, "en", "s1")] + [rows[5]] * 3
    if small:  # several shards, blocks and flushes; texts in pieces
        for name, value in (("SHARD_ROWS", 60), ("BLOCK", 2), ("HELD", 20), ("PIECE", 11)):
            monkeypatch.setattr(divergence, name, value)
    got = divergence.audit(_table(spark, rows).repartition(5), "body", "lang", "source", least_docs=4, top=3)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == _audit(rows, 4, 3)


def test_divergence_of_empty_and_termless_tables(spark):
    assert divergence.audit(_table(spark, []), "body", "lang", "source").collect() == []
    rows = [(None, None, None), ("x", "en", "a"), ("y", "en", "b")]
    assert sorted(map(tuple, divergence.audit(_table(spark, rows), "body", "lang", "source").collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_terms_of_pieces(monkeypatch):
    text = "Über-alles, NAÏVE naïve\u00a0x\x00y 12 a_b " * 50
    whole = divergence.terms_of(text)
    monkeypatch.setattr(divergence, "PIECE", 3)
    assert divergence.terms_of(text) == whole and whole["naïve\u00a0x".encode()] == 50


def test_a_shard_of_many_small_batches_is_added_up(monkeypatch):
    """More partial rows than a shard holds: they are added up again and again."""
    import pyarrow as pa

    for name, value in (("SHARD_ROWS", 20), ("BLOCK_ROWS", 3)):
        monkeypatch.setattr(divergence, name, value)
    dice, want, batches = random.Random(4), Counter(), []
    for _ in range(300):
        rows = [(dice.choice(["en", "de"]), dice.choice("abc"), dice.choice(["x", "yé", "z", "w"]), dice.randrange(1, 5), 1) for _ in range(dice.randrange(3))]
        batches.append(pa.RecordBatch.from_pylist([dict(zip(divergence.PARTIAL.names, r)) for r in rows], divergence.PARTIAL))
        for lang, source, term, n, _ in rows:
            want[lang, term, source] += n
    got = {(r["lang"], r["term"], s): n for b in divergence._add_up(1)(iter(batches)) for r in b.to_pylist() for s, n in zip(r["sources"], r["counts"])}
    assert got == want and list(divergence._add_up(10**6)(iter(batches))) == []
