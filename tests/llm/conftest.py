import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # columns whose names clash with those that operators add
        T.StructField("size", T.StringType()),
        T.StructField("shard", T.IntegerType()),
    ]
)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) tuples, with clashing extra columns."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r))) for r in rows]
        return spark.createDataFrame([(*r[:4], len(r[1] or ""), "x", 7) for r in full], DOCS)

    return make


@pytest.fixture
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long_text = ("wörter and words, 123 " * 20_000).strip()
    return [
        (1, "the same text here", "en", "a"), (2, "the same text here", "en", None), (2, "the same text here", "en", None),
        (3, None, None, "b"), (4, "", "de", "b"), (None, "no id at all", "en", "a"), (5, long_text, "de", "a"),
        (6, " \n\t ", "fr", None), (7, "中文没有空格" * 50, "en", "c"), (8, "a  b   c\n\n d ", "en", "c"),
    ]


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
