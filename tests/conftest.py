import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from quillstone.session import get_session

    s = get_session("tests", os.environ.get("TEST_MASTER", "local[4]"), spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false", spark__driver__memory="3g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    """The smallest test tables; tests on them are skipped where they aren't."""
    d = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
    if not Path(d).is_dir():
        pytest.skip("no test tables here")
    return d


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))
