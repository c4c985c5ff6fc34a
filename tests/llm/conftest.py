import pytest

LONG = "lang wort " * 40_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns with the operators' names."""
    rows = [
        (1, "The first text, with some words in it that go on for a while.", "en", "a"),
        (1, "The first text, with some words in it that go on for a while.", "en", "a"),
        (2, None, None, None),
        (3, "", "en", "b"),
        (4, " \n\t ", "fr", None),
        (5, LONG, "de", "a"),
        (6, LONG, "de", "a"),
        (None, "A text that has no number at all, but words enough.", "en", "c"),
        (None, None, None, None),
        (7, "é漢🙂 ééé x y \x00z", "xx", "c"),
        (8, "one", "en", "c"),
    ]
    wide = [(i, t, lang, src, None if t is None else len(t), 0.5, 1, "k", [1], None) for i, t, lang, src in rows]
    schema = (
        "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, of_doc int, key string, "
        "tokens array<int>, contamination string"
    )
    return spark.createDataFrame(wide, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="session")
def more_documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
