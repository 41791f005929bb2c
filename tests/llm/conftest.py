import pytest
from pyspark import cloudpickle

import spanloom
from spanloom.llm.common import ready

cloudpickle.register_pickle_by_value(spanloom)


@pytest.fixture
def docs(spark):
    """A table of documents with columns whose names operators use inside."""

    def make(rows, extra=True):
        df = ready(spark).createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string")
        if extra:
            df = df.selectExpr("doc_id", "text", "doc_id AS _row", "text AS name", "1 AS n", "text AS key", "2 AS _bucket", "text AS _text", "0 AS start")
        return df

    return make
