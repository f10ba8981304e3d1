import pytest

from gazetteer.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("4", "tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def one(spark):
    """Value of a column expression without a table."""
    def get(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    return get
