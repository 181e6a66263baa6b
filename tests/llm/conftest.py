import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import local_session

    return local_session("4", shuffle_partitions=4)


#: A table as an operator may meet it: further columns, names that differ in case alone, and names that operators use inside.
ODD = T.StructType([
    T.StructField("Text", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("score", T.StringType()), T.StructField("h", T.StringType()), T.StructField("uid", T.StringType()), T.StructField("LANG", T.StringType()),
])


@pytest.fixture(scope="session")
def odd(spark):
    """odd([(doc_id, text), ...] or [(doc_id, text, lang), ...]) as a table with odd further columns."""
    def make(rows):
        full = [("x", r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1]), "y", "z", None, "w") for r in rows]
        return spark.createDataFrame(full, ODD)
    return make


@pytest.fixture(scope="session")
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    return make
