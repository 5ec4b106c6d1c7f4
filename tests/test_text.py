import numpy as np
import pytest
import regex
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sievework.functions import text as T
from sievework.operators.names import parse_name_path, suggest
from sievework.operators.retrieve import HashVectors, bm25, expand_seeds, hybrid, parse_channels, placed, query_terms, rrf, vector_hits
from sievework.semantics import Semantics


@pytest.mark.parametrize(
    "pattern, yes, no",
    [("a*c", ["ac", "abbc"], ["a/c", "abd"]), ("?x", ["ax"], ["/x", "x"]), ("[a-c]d", ["bd"], ["dd"]), ("[^a]d", ["bd"], ["ad"]), (r"a\*", ["a*"], ["ab"]), ("a.b", ["a.b"], ["axb"])],
)
def test_globs(pattern, yes, no):
    r = regex.compile(T.glob_regex(pattern).replace("(?s:", "(?s:"))
    assert all(r.match(x) for x in yes) and not any(r.match(x) for x in no)


def test_bad_globs_match_themselves_or_pass(spark):
    assert T.glob_regex("[a") is None and T.glob_regex("a\\") is None
    df = spark.createDataFrame([("[a",), ("b",)], "x string")
    assert [r.x for r in df.where(T.matches_glob(F.col("x"), "[a")).collect()] == ["[a"]
    assert df.where(T.path_passes_glob(F.col("x"), "[a")).count() == 2


def test_patterns_of_other_dialects_are_refused():
    assert T.java_pattern("(?P<n>a)") == "(?<n>a)"
    for p in ("(?=a)", "(?<!a)", r"(a)\1", "a++", "(?>a)", "x" * 5000, "(a"):
        with pytest.raises(ValueError):
            T.java_pattern(p)
    for p in (r"\\1", r"[+*]+", r"\p{L}+", "a{2,3}"):
        assert T.java_pattern(p) == p


def test_tokens_snippets_distance_sanitize(spark):
    df = spark.createDataFrame([("Ab_1 ÉTÉ\tx-y\n", "é" * 150, "kitten", "a\u200bb\ufeff"), ("", "short", "é", "c")], "t string, s string, d string, z string")
    rows = df.select(T.tokens(F.col("t")).alias("t"), T.snippet(F.col("s")).alias("s"), T.byte_distance(F.col("d"), F.lit("sitten"), 9).alias("d"), T.byte_distance(F.lit("e"), F.col("d"), 9).alias("e"), T.sanitize(F.col("z")).alias("z")).collect()
    assert rows[0].t == ["ab_1", "été", "x", "y"] and rows[1].t == []
    assert rows[0].s == "é" * 100 + "…" and rows[1].s == "short"
    assert rows[0].d == 1 and rows[1].e == 2 and rows[0].z == "ab"


def test_terms():
    assert T.split_terms('a "b c" d') == ["a", "b c", "d"]
    assert T.split_terms('unclosed "phrase', strict=False) == ["unclosed", "phrase"]
    assert T.split_terms("  a  ") == ["a"]
    with pytest.raises(ValueError):
        T.split_terms('a "b')
    assert query_terms("Foo_1 bar-Foo_1") == ["foo_1", "bar", "foo_1"]


@given(st.lists(st.text(min_size=1, max_size=5), max_size=8))
def test_embedding_has_length_one(words):
    v = T.embed_tokens(words, 64)
    assert not words or abs(np.linalg.norm(v) - 1) < 1e-9 or not v.any()


PINNED_BOLT = {5: -1, 7: 1, 38: 1, 56: -1}


def test_embedding_of_known_words():
    """Cells and signs worked out from the published 64-bit FNV-1a: a set bit 32 counts +1."""
    def fnv(data):
        h = 14695981039346656037
        for b in data:
            h = (h ^ b) * 1099511628211 % 2**64
        return h

    assert fnv(b"a") == 0xAF63DC4C8601EC8C and fnv(b"foobar") == 0x85944171F73967E8  # published test vectors
    want = np.zeros(64)
    for i in range(4):
        h = fnv(bytes([i]) + b"bolt")
        want[h % 64] += 1 if bin(h)[2:].zfill(64)[31] == "1" else -1
    assert T.embed_tokens(["bolt"], 64) == pytest.approx(want / np.linalg.norm(want)) and want.any()
    assert {int(k): int(v) for k, v in enumerate(want) if v} == PINNED_BOLT


def test_name_paths():
    assert parse_name_path("fn:a.b.C") == ("a.b", "C") and parse_name_path("a/b/C") == ("a.b", "C") and parse_name_path("C") == ("", "C")


def test_suggestions(spark):
    names = spark.createDataFrame([("Charge",), ("Change",), ("Charge",), ("Other",), ("",)], "n string")
    assert [(r.name, r.distance) for r in suggest(names, "n", "pkg.Charg").collect()] == [("Charge", 1), ("Change", 2)]


def _hits(spark, *ids):
    return spark.createDataFrame([(i, float(len(ids) - n)) for n, i in enumerate(ids)], "id string, score double")


def test_rrf_scores(spark):
    got = {r.id: r.score for r in rrf({"a": _hits(spark, "α", "β", "γ"), "b": _hits(spark, "α", "β"), "c": _hits(spark, "α")}).collect()}
    assert got == pytest.approx({"α": 3 / 61, "β": 2 / 62, "γ": 1 / 63})


def test_whole_lists_are_ranked_by_ranges(spark):
    n = 25_000
    many = spark.range(n).selectExpr("id", "CAST(pmod(id * 7919, 997) AS double) AS score").repartition(7)
    for short in (False, True):
        got = {r.id: r.rank for r in placed(many, short).collect()}
        assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(range(n), key=lambda i: (-(i * 7919 % 997), i)) and sorted(got.values()) == list(range(1, n + 1))
    assert rrf({"a": many}).count() == n and placed(many.where("false")).count() == 0


def test_rrf_counts_an_id_twice_and_names_the_first_channel(spark):
    twice = spark.createDataFrame([("x", 2.0), ("x", 1.0)], "id string, score double")
    r = rrf({"a": _hits(spark, "y"), "b": twice}, 1).first()
    assert (r.id, r.channel) == ("x", "b") and r.score == pytest.approx(1 / 61 + 1 / 62)


def test_bm25_order_and_empty_texts(spark):
    docs = spark.createDataFrame([("a", "cart charge charge"), ("b", "cart"), ("c", ""), ("d", None), ("e", "other words here")], "id string, text string")
    assert [r.id for r in bm25(docs, "id", "text", "charge cart").collect()] == ["a", "b"]
    assert bm25(docs, "id", "text", "!!").count() == 0
    assert bm25(docs.where("false"), "id", "text", "cart").count() == 0
    once = bm25(docs, "id", "text", "cart").where("id = 'b'").first().score
    assert bm25(docs, "id", "text", "cart cart").where("id = 'b'").first().score == once
    often = Semantics(repeated_terms=True)
    assert bm25(docs, "id", "text", "charge charge", semantics=often).first().score != bm25(docs, "id", "text", "charge").first().score


def test_vector_and_hybrid(spark):
    chunks = spark.createDataFrame([("a", "red fox jumps"), ("b", "blue whale sings"), ("c", "green tree")], "id string, text string")
    assert HashVectors(256).top_k(chunks, "red fox", 3).first().id == "a"
    top = hybrid(chunks, None, "blue whale", ["bm25", "vector"], 2)
    assert top.first().id == "b" and top.first().chunk.text == "blue whale sings"
    assert expand_seeds(top, 1)[0] == ["b"]
    with pytest.raises(ValueError):
        hybrid(chunks, None, "x", [])
    assert parse_channels("bm25, vector") == ["bm25", "vector"]
    with pytest.raises(ValueError):
        parse_channels("nope")


def test_a_hybrid_answer_scores_the_chunks_once(spark):
    chunks = spark.createDataFrame([("a", "red fox jumps"), ("b", "blue whale sings"), ("c", "green tree")], "id string, text string")

    class Once:
        asked = spark.sparkContext.accumulator(0)

        def top_k(self, chunks, query, k):
            asked = self.asked

            @F.udf("double")
            def score(text):
                asked.add(1)
                return 1.0 / len(text)

            return chunks.select("id", score.asNondeterministic()("text").alias("score")).unionAll(spark.createDataFrame([("gone", 9.0)], "id string, score double"))

    backend = Once()
    assert [r.id for r in hybrid(chunks, None, "blue whale", ["vector"], 2, backend).collect()] == ["c", "a"]
    assert backend.asked.value == 3
    there = vector_hits(chunks.select("id").unionAll(spark.createDataFrame([("gone",)], "id string")), chunks.unionAll(chunks))
    assert sorted(r.id for r in there.collect()) == ["a", "b", "c"]


def test_tokens_are_taken_apart_in_slices():
    import numpy as np
    import pyarrow as pa
    from sievework.functions import text

    texts = ["a\x1fb\x1fa", None, "", "b\x1fü", "c\x1f" * 50 + "c", "a"]
    col = pa.array(texts)
    assert [x for x in text.text_slices(col, 2, 10)] == [(0, 2), (2, 4), (4, 5), (5, 6)] and list(text.text_slices(pa.array([], pa.string()))) == []
    names, at, counts = text.numbered_tokens(col)
    assert list(counts) == [3, 0, 0, 2, 51, 1] and [names[k] for k in at[:5]] == ["a", "b", "a", "b", "ü"]
    want = text.embed_many([t.split("\x1f") if t else [] for t in texts], 64)
    assert np.array_equal(np.concatenate(list(text._embed_joined(col, 64))), want)
