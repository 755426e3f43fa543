import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def messy(spark):
    """Null, empty, blank, repeated, tied and long texts, null and repeated keys, clashing extra columns."""
    rows = [
        (1, "Alpha beta gamma  delta\n\nepsilon", "x"),
        (2, None, "x"),
        (3, "", None),
        (4, " \t\n", "x"),
        (5, "same text twice here now", "x"),
        (5, "same text twice here now", "x"),
        (5, "another text of the same key", "y"),
        (None, "no key at all <|endoftext|> it's", "x"),
        (None, None, None),
        (9, "lorem ipsum dolor " * 4000, "x"),
        (10, "é漢字 \x1cña  don't stop " + "x" * 3000, "x"),
    ]
    return spark.createDataFrame([(a, b, c, "clash", 1, 2) for a, b, c in rows], "doc_id bigint, text string, lang string, key string, digest int, ids_ int")


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
