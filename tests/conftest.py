import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from sievework.session import local_session

    session = local_session(cores=4, memory="4g", name="tests", partitions=4)
    yield session
    session.stop()
