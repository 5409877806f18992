import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for Spark's Python workers
TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import build_session

    return build_session(4, shuffle_partitions=4)
