import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 40_000 + "end."


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns with clashing names."""
    rows = [
        (1, None, "en", "s", None),
        (2, "", "en", None, 0),
        (3, " \n\t ", None, "s", 4),
        (4, LONG, "en", "s", len(LONG)),
        (5, "the same text in two rows, which is here twice.", "en", "s", 47),
        (5, "the same text in two rows, which is here twice.", "en", "s", 47),
        (6, "the same text in two rows, which is here twice.", "de", "s", 47),
        (None, "no id but a text", "en", "s", 16),
        (None, None, None, None, None),
        (7, "漢字 и буквы ½ \x1c\xa0é <|endoftext|> don't 123", "zz", "s", 40),
        (8, "12 34 !!", "en", "s", 8),
    ]
    clash = [(*r, "x", 1, 2.0) for r in rows]
    return spark.createDataFrame(clash, SCHEMA + ", n_words string, shard int, score double").cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def no_labels(labels):
    return labels.where("false")
