import pytest
from pyspark.sql import types as T

DOC = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


@pytest.fixture(scope="session")
def docs(spark):
    """A frame of documents from texts; ids count from 0, or come with the texts."""

    def make(texts, sources=None):
        rows = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", (sources or {}).get(i, "s"), len(t or "")) for i, t in rows], DOC)

    return make
