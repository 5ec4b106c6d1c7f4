import pytest

WORDS = "the cart of the shop and a long way to pay for it with some other things that we all know well enough by now".split()


def prose(n, salt=0):
    """Deterministic text of n words."""
    out, x = [], salt * 7919 + 17
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 16) % len(WORDS)] + (str(x % 97) if x % 5 == 0 else ""))
    return " ".join(out)


def documents(spark, rows):
    """(doc_id, text) rows as a table with the usual columns and some that clash with names used inside."""
    full = [(i, t, "en", "src0", len(t or ""), 0.5, "x", 1, 2, "k") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double, id string, n long, cls long, `odd name` string")


EDGE = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, prose(60)), (6, prose(60)), (7, prose(60) + " end"), (8, prose(60).upper()),
    (9, prose(30_000, 3)), (10, "!!! ??? 123"), (None, prose(20, 5)), (11, "ÄÖÜ ß é 漢字 \U0001f600"), (12, "x" * 50_000), (13, "a\x00b\x0bc"),
]


@pytest.fixture(scope="session")
def edge(spark):
    return documents(spark, EDGE).cache()


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, []).cache()
