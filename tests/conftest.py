import pytest

from larder.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return session
