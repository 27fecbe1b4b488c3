import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture()
def frame(spark):
    """Rows as a table with a document's columns, one clashing extra column and several partitions."""

    def make(rows, parts=3):
        names = "doc_id long, text string, lang string, source string, n_chars long, row string, `id` string, fp string"
        full = [(i, t, "en", "s", None if t is None else len(t), "r", "x", "y") for i, t in rows]
        return spark.createDataFrame(full, names).repartition(parts)

    return make
