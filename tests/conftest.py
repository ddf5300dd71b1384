import pytest

from bitloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return session


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
