import pytest

from claimscope.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, **{"spark.driver.memory": "4g", "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
