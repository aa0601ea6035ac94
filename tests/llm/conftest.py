import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, node string, held_out string, toxicity double, text_md5 string"


@pytest.fixture(scope="session")
def odd(spark):
    """Null columns, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    near = " ".join(f"word{i}" for i in range(60))
    passage = "Seven purple lanterns drifted slowly over the quiet harbour while nobody watched them leave again"
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (None, "a text without an id", "en", None, 20), (4, near, "en", "a", 1), (5, near, "de", "b", 1),
        (6, near.replace("word30", "other"), None, "b", 1), (6, near.replace("word30", "other"), None, "b", 1), (7, "x" * 200_000, "en", "a", 1), (8, "very long text of words " * 8000, "en", "a", 1),
        (9, f"before {passage} after", "en", "a", 1), (10, f"before {passage.replace('quiet', 'loud').replace('nobody', 'somebody')} after", "en", "a", 1), (11, "mail me: a.b@example.com or +1 (663) 555-6869, 1.2.3.4", "en", "a", 1),
        (12, "\U0001f600 4111111111111111 déjà vu 名前", "fr", "a", 1), (13, 'token = "f0ddae3b09ae356cbefecdd3232fa5489bb400d6" and more', "en", "a", 1), (14, "you idiot moron", "en", "a", 1),
    ]
    return spark.createDataFrame([(*r, 0.5, "s", "n", "h", 0.1, "q") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("doc_id = -5")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, "Seven purple lanterns drifted slowly over the quiet harbour while nobody watched them leave again"), (2, None), (3, ""), (4, "too short")], "item_id long, text string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i in (14, 12))) for i in range(2, 15)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
