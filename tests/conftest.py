import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from postprism.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "postprism-tests",
        master="local[4]",
        spark__sql__shuffle__partitions="4",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="postprism-tests-"),
        spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="postprism-warehouse-"),
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
