import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from evalmill.session import session, ship

    s = session("tests", cpus=4, spark__sql__shuffle__partitions="4")
    ship(s)
    yield s
    s.stop()
