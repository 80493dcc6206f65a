import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs."""

    def make(*rows, **more):
        data = [(i, t, more.get("lang", {}).get(i), "src", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(data, DOCS)

    return make


@pytest.fixture(scope="session")
def sf_path(spark, tmp_path_factory):
    """A folder of tables as the queries read them."""

    def write(**tables):
        at = tmp_path_factory.mktemp("tables")
        for name, frame in tables.items():
            frame.write.parquet(f"{at}/{name}.parquet")
        return str(at)

    return write


ODD = [(1, "One two three four five.\nSix seven, eight."), (2, None), (3, ""), (4, "\n\n \t　x\r\n"), (5, "é́\0😀<|endoftext|> can't 123"), (5, "One two three four five.\nSix seven, eight."), (None, "no id here at all"), (7, "word " * 30_000)]


@pytest.fixture(scope="session")
def odd():
    return ODD
