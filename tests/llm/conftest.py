import pytest

#: Rows that every operator must take: nulls, nothing, white space, long, repeated, odd characters.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. The end.", "en", "s", 5),
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (4, " \t\n \n", "fr", None, 4),
    (5, "wörd " * 3000, "de", "s", 5),
    (6, "The quick brown fox jumps over the lazy dog. The end.", "en", "t", 5),
    (6, "The quick brown fox jumps over the lazy dog. The end.", "en", "t", 5),
    (None, "a text without an id\nof three lines\nor so\nand one", "xx", "s", 1),
    (7, "ünï▁cödé 日本語 😀 <|endoftext|> \x00 <s> ﬁ", "es", "s", 1),
    (8, "one line\nof three\nor so\none line\nof three\nor so", "en", "s", 1),
    (9, "x" * 5000, "en", "s", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def piece_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def word_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
