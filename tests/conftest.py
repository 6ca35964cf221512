import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from theoremill.runtime import build_session

    # Small tables: compiling each plan would take longer than running it.
    session = build_session("tests", 4, spark__sql__shuffle__partitions="2", spark__sql__codegen__wholeStage="false", spark__driver__memory="3g")
    yield session
    session.stop()
