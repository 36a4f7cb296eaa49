import pytest
from pyspark.sql import types as T

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PROSE = "the quick brown fox jumps over a lazy dog while many small birds sing songs in the old green trees near our house"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, with extra columns whose names operators use."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", "1 AS size", "2 AS score", "'x' AS ids", "true AS kept", "3 AS _key", "4 AS part", "5 AS n", "6 AS key")

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, control characters and one very long text."""
    words = PROSE.split()
    long = " ".join(words[(i * i) % len(words)] + str(i % 997) for i in range(30_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, PROSE), (4, PROSE), (5, PROSE), (6, long), (7, "\x00\x01 ▁ 日本 </s>"), (None, "no id")]


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], T.StructType.fromDDL("doc_id bigint, quality int, toxic int"))
