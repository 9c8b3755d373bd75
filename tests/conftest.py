import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from graphloom.session import local_session, ship

    s = local_session(4, 4, "3g")
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
