import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from mediaguard.plans.session import local_session
    s = local_session(8, partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
