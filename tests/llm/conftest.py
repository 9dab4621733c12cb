"""Small tables for the operators' tests."""

import pytest


@pytest.fixture
def texts(spark):
    """Documents from (doc_id, text) pairs; a column whose name clashes with an operator's own is added."""

    def make(*rows):
        return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id bigint, text string, part string, rank int")

    return make


@pytest.fixture
def vectors(spark):
    def make(*rows):
        return spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id bigint, embedding array<float>, rank int")

    return make
