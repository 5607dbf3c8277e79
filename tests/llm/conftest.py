import pytest
from pyspark.sql import types as T

FOLDER = "/root/testdata/sf0.001"
DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that operators use for their own columns.
    T.StructField("score", T.StringType()), T.StructField("_group", T.StringType()), T.StructField("rank", T.LongType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, None, None, None, "x", None, 7) for i, t in zip(ids, texts, strict=True)], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    return [
        "", None, " ", "  ", "a", "a  b", " a b ", "\n", "a\n\nb", "x\ny", "é  b", "it's  'S 's", "<|endoftext|> x<|endoftext|>", "\0a b",
        "ΑΣ ΑΣ", "e ́x", "a\x1cb \x1c c", "İ I", "12 345a", "日本 語", "a\tb\t c", "x x x ", " ".join(["ab"] * 3000), " a", "a\r\nb",
        "ſ ﬁ K", "aaa ab" * 50, "a" * 999, "x" * 33 + "yx" * 20, "same text here", "same text here",
    ]
