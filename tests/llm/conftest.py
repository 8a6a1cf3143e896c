"""Small fixtures for the corpus operators: every awkward kind of row in one table."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the quick brown fox jumps over the lazy dog near the old river bank while seven birds sing"
DE = "der schnelle braune fuchs springt über den faulen hund am alten flussufer und sieben vögel singen"


@pytest.fixture(scope="session")
def awkward(spark):
    """Null in every column, empty, blank and very long texts, ties, repeated rows."""
    rows = [(i, f"{EN} number {i}", "en", "a", 1) for i in range(20)]
    rows += [(100 + i, f"{DE} nummer {i}", "de", "b", 1) for i in range(20)]
    rows += [(200, None, "en", "a", None), (201, "", "en", None, 0), (202, " \n\t ", None, "a", 3),
             (203, "12345 !!!", None, "a", 9), (None, EN, "en", "a", 5), (204, EN, None, None, None),
             (205, EN, "en", "a", 1), (205, EN, "en", "a", 1), (206, EN + " " + "word " * 40_000, "en", "a", 1),
             (207, "x" * 50_000, "en", "a", 1), (208, "日本語 テキスト ñ 😀", None, "c", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(4)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def piece_path():
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def word_path():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")
