import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
# Names that the operators use inside.
CLASHING = ("id", "t", "h", "k", "b", "n", "g", "key", "node", "line", "lines", "spans", "place",
            "kept_", "shard_", "block", "component", "distance_", "vec", "ids", "row")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def document_rows(documents):
    return [(r.doc_id, r.text, r.lang, r.source) for r in documents.collect()]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, with further columns of clashing names."""
    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", None) for i, t in zip(ids, texts)]
        docs = spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string").repartition(3)
        return docs.select("*", F.length("text").cast("long").alias("n_chars"),
                           *[F.lit(7).alias(c) for c in CLASHING])
    return make


ODD_TEXTS = [None, "", " \n\t ", "one", "One two, three.", "\n\n", "word " * 3000,
             "x" * 20000, "né tz \x1c ß İ 😀 é", "a b c d e f g h i j k l",
             "a b c d e f g h i j k l", "A b c D e f g h i j k l", "  a  b\r\nc\td  "]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Nulls, empty and long texts, ties, repeated rows, a null id."""
    return make_docs([*ODD_TEXTS, "one", "again and again"],
                     [*range(len(ODD_TEXTS)), 3, None])


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
