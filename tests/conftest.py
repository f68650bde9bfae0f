from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from panelyst.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    staging = str(tmp_path_factory.mktemp("staging"))
    session = local_session("*", shuffle_partitions=4, app="panelyst-tests", staging=staging)
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a frame as a set-comparable sorted list of tuples."""

    def collect(df, *cols):
        out = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
        return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x) if x is not None else (True, "", 0) for x in r))

    return collect
