import pytest

from wordloom.session import build_session, ship


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    ship(session)
    yield session
    session.stop()
