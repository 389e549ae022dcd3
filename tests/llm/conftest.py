import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """A DataFrame from tuples and a schema string, in a few partitions."""

    def make(data, schema):
        return spark.createDataFrame(data, schema).repartition(3)

    return make


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
