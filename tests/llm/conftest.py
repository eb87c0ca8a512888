import pytest

from roamer.llm.queries import tokenizer_path


@pytest.fixture(scope="session")
def bpe_path():
    return tokenizer_path()


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [
        (1, None, "en", 5), (2, "", "en", 5), (3, "a   b\n\n c\t", None, 6), (3, "a   b\n\n c\t", None, 6), (4, "x<|endoftext|>y <|endoftext|>", "fr", 1),
        (5, "it's we'll 123 ½ ② 中文字 🙂 é x　y", "en", None), (6, "word " * 30_000, "en", 2), (7, "A" * 5_000, "de", 3), (None, "no id at all here", "en", 4), (8, "a b c", "de", 5), (9, "A B  C", "de", 5),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, row long").selectExpr("*", "lang AS digest", "row AS slot", "row AS maybe", "lang AS id")
