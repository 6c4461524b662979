import pytest

from tessera.runtime import session


@pytest.fixture(scope="session")
def spark():
    s = session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
