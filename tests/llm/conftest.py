import pytest

#: Whole texts that each operator must take: nulls, empty, blank, one word, long, repeated.
ODD_TEXTS = [None, "", " \t\n", "a", "word", "same text here now", "same text here now", "x" * 30_000, "ab cd " * 5_000, "日本語 текст mixed <|endoftext|> é", "A B C", "ß ﬁ İ ẞ"]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents: null ids and sources, repeated rows, and columns that clash with operators' own."""
    rows = [(None if i == 3 else i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None if t is None else len(t), "k", 7) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[9]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, size int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
