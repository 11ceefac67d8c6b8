import pytest
from pyspark.sql import types as T

TEXT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
FULL = T.StructType([*TEXT.fields, T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a table (doc_id, text) from pairs, with columns whose names the operators use inside."""
    def make(*rows):
        base = spark.createDataFrame([tuple(r) for r in rows], TEXT)
        return base.selectExpr("*", "'x' AS key", "'y' AS n", "1 AS component", "'z' AS rep", "2 AS doc", "3 AS start", "4 AS other", "5 AS stratum")

    return make
