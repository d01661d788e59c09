import pytest

from leafmill import core


@pytest.fixture(scope="session")
def spark():
    s = core.session("local[8]", 8)
    core.ship(s)
    return s
