import pytest

from querent.session import session


@pytest.fixture(scope="session")
def spark():
    spark = session("tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
