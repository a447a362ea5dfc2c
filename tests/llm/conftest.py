import pytest

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing in the tall green trees today"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing in the tall green trees today"),
    (3, "A note. The quick brown fox jumps over the lazy dog near the old river bank while seven small birds sing in the tall green trees tonight"),
    (4, None),
    (5, ""),
    (6, " \n\t "),
    (7, "one"),
    (8, "Ünïcode wörds   and　more \x1c \x85 é \U0001f600 <|endoftext|> end "),
    (9, "long " * 3000 + "tail"),
    (5, ""),
    (None, "a row without an id but with words enough to be counted as one of them"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with names the operators use themselves."""
    rows = [(i, t, "en", "s", len(t or ""), "x", 1, "y", 2) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, doc int, at string, n_words int")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
