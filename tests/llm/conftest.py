import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that the operators use themselves
    "size long, key long, entry long, n_words long, keep_id long, th long, taken double, a long, label string, `text_sha256` string"
)


def make(spark, rows):
    """Documents ``(doc_id, text, source)`` with columns whose names clash."""
    full = [(i, t, "en", s, len(t or ""), 1, 2, 3, 4, 5, 6, 7.0, 8, "x", "y") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(seed, n, size=6):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeéüx") for _ in range(rng.randint(1, size))) for _ in range(n)]


@pytest.fixture(scope="session")
def make_docs(spark):
    return lambda rows: make(spark, rows)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls everywhere, empty, blank and very long texts, ties and repeated rows."""
    base = words(1, 120)
    near = base[:60] + ["changed"] + base[61:]
    rows = [
        (1, " ".join(base), "b"),
        (2, "  ".join(base), "b"),
        (3, " ".join(near), "a"),
        (4, None, "a"),
        (5, "", None),
        (6, " \t\n ", None),
        (7, "one two", "c"),
        (8, "one  two", "c"),
        (8, "one  two", "c"),
        (9, " ".join(words(2, 60_000)), "c"),
        (10, "É ü <|endoftext|> ÉÉ 😀 中文 don't", "c"),
        (None, " ".join(words(3, 70)), "a"),
        (None, " ".join(words(3, 70)), "a"),
        (11, " ".join(["x y z"] * 40), "d"),
        (12, "\n".join(["same line here"] * 5 + words(4, 60)), "d"),
        (13, "$$ ## && " * 30, "d"),
    ]
    return rows


@pytest.fixture(scope="session")
def edge_docs(make_docs, edge_rows):
    return make_docs(edge_rows).repartition(3)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
