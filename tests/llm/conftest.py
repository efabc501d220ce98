import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, blank, long, repeated and tied rows, and columns with names that results have."""
    long = " ".join(f"wort{i % 977} the of" for i in range(3000))
    rows = [
        (1, "The cat and the dog are in the house.\nIt was a good day for all of us and you.", "en"), (2, None, "en"), (3, "", None), (4, "  \n\t ", "de"),
        (5, "Der Hund und die Katze sind in dem Haus, und das ist nicht für alle.", "de"), (6, long, "en"), (7, "1234 !!! ###", "en"), (1, "The cat and the dog are in the house.\nIt was a good day for all of us and you.", "en"),
        (None, "An id is missing here but the text is not.", None), (8, "é漢字  ok", "fr"),
    ]
    rows = [(i, t, lang, None if i in (3, 5) else f"s{(i or 0) % 2}", "kept", -1.0, "x") for i, t, lang in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, extra string, score double, fingerprint string")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
