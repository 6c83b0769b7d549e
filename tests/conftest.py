from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from velospan.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    made = session(
        "velospan-tests",
        "local[4]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="velospan-tests-"),
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
