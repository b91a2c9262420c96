import pytest
from .odd_rows import ODD
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text[, lang]) rows."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls in every place, empty and very long texts, ties and repeated rows, and columns whose names
    clash with those that operators use inside."""
    from pyspark.sql import functions as F

    names = ("doc", "row", "block", "text_key", "node", "class_id", "score", "words", "start", "runs", "ids", "v", "shard", "__key", "__doc", "__runs", "__had", "size", "place", "gram")
    return docs_of(ODD).withColumns({n: F.lit(None).cast("string") for n in names})


@pytest.fixture(scope="session")
def none(docs_of):
    return docs_of([])
