import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        """Documents from (doc_id, text[, source])."""
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else None, None) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empties, blanks, ties, repeated rows, a very long text."""
    return docs_of([(5, "b c d e f g"), (5, "b c d e f g"), (5, "x"), (None, "null id"), (7, None), (8, ""), (9, " \n\t "), (10, "word " * 60_000), (11, "1 2 3 " * 20_000), (3, "é日本 <|im_end|> a@b.co"), (2, None, "s"), (1, "one", "s")])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def path():
    import public_tokenizers

    return public_tokenizers.path


def same_schema(a, b):
    return [f.name for f in a.schema.fields] == [f.name for f in b.schema.fields] and isinstance(a.schema, T.StructType)
