from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from catalith.session import session

    where = tmp_path_factory.mktemp("spark")
    s = session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__checkpoint__dir=f"file://{where}/checkpoints", spark__sql__warehouse__dir=f"file://{where}/warehouse")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
