import pytest

from evidex.session import build


@pytest.fixture(scope="session")
def spark():
    session = build(4, shuffle_partitions=4, memory="6g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def catalog(spark, sf):
    from evidex.plans.views import Catalog

    return Catalog(spark, sf)
