import pytest

ODD = [
    (1, "plain words here", 7),
    (2, None, 7),
    (None, "no id", 7),
    (3, "", 7),
    (4, " \n\t ", 7),
    (1, "plain words here", 7),
    (5, "x" * 300_000, 7),
    (6, "ключ 漢字 🎉 é \x00 \x1c end", 7),
]


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty, blank, repeated, very long and unusual texts, with extra columns whose names clash with results."""
    d = spark.createDataFrame(ODD, "doc_id long, text string, n_words int")
    from pyspark.sql import functions as F

    return d.withColumns({c: F.lit("mine") for c in ("kept", "score", "n_tokens", "spans", "v", "r", "__kept", "key", "component_id", "n_hit", "bpe", "a", "id")})


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
