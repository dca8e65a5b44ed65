import pytest

#: Every operator meets these: nulls, blanks, repeats, near copies, a long text, clashing columns.
BASE = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark wood where nobody has ever been before but the owl who sees all that moves at night "


def long_text(n):
    return " ".join(f"{w}{i % 97}" for i in range(n) for w in ("alpha", "beta"))


@pytest.fixture(scope="session")
def rows():
    shared = " ".join(f"word{i}" for i in range(60))
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, BASE * 3, "en", "a"), (5, BASE * 3, "en", None), (6, BASE.upper() * 3, "fr", "b"), (7, f"start {shared} end", "fr", "b"), (8, f"other {shared}", "fr", "c"), (9, long_text(20000), "de", "c"),
        (10, "Éa ñó été 中文 🙂 ℵ", "es", "ü"), (11, "12 34 !!", None, "z"), (12, "word", "en", "a"), (12, "word", "en", "a"), (14, "one of a kind here", "en", "a"), (14, BASE * 3, "en", "b"), (None, "no id here", "en", "a"), (-5, "négative id. stupid idiot!", "en", "a"),
    ]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Documents with extra columns whose names clash with those that operators make."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.selectExpr("*", "length(text) n_chars", "1 score", "2 size", "3 taken", "4 fingerprint", "5 component_id", "6 shard", "7 block", "8 key", "9 n", *(f"{k} {c}" for k, c in enumerate("__score __spans __id __size __at __key __shard __taken n_words spans items row id hash at bucket a".split())))


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("1 = 0")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (6, 0, 1), (None, 1, 1), (9, None, None), (9, 1, 0)], "doc_id long, quality int, toxic int")
