import pytest

from lexora.session import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", cores=4, shuffle_partitions=4, driver_memory="4g")
    yield s
    s.stop()
