from __future__ import annotations

import sys
from pathlib import Path

import pytest
from hypothesis import settings

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from paragraf.session import local_session, prepare


settings.register_profile("same", derandomize=True, deadline=None)
settings.load_profile("same")


@pytest.fixture(scope="session")
def spark():
    session = prepare(local_session(4, 4, "tests"))
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session
