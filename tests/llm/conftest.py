import pytest
from rows import DOCS, awkward_rows, spoilt


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(spoilt(awkward_rows()), DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
