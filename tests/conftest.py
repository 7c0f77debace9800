import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from frameloom.session import get_session

    s = get_session(8, 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
