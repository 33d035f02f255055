import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from check_queries import session

    from hitloom.session import tune

    s = tune(session())
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("work")))
    return s
