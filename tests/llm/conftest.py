import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, id long, tid long, body string, _quality int, src string"


@pytest.fixture(scope="session")
def nasty(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns that operators might use themselves."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "b"), (4, long, "en", "a"), (5, "same text here again", "en", None), (6, "same text here again", "en", "c"),
        (6, "same text here again", "en", "c"), (None, "same text here again", None, "c"), (None, "only null id \U0001f600 é", "en", "c"), (7, "x" * 200_000, "en", "c"), (8, "one\r\n\r\ntwo\x0bthree\u00a0four", "en", "b"),
        (9, "\n\n\n", "en", "b"), (6, "another text under the same id", "en", "c"), (10, "token = 'abcdEFGH12345678'", "en", "a"),
    ]
    data = [(d, t, lang, s, 1, 0.5, 7, 8, 9, "body", 3, "z") for d, t, lang, s in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
