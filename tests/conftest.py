import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from evisparq.session import local_session

    return local_session(cores=8, memory="6g", shuffle_partitions=4)
