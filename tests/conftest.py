import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from repovigil.session import local_session, ship_package  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests", spark__sql__shuffle__partitions="4")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture()
def files(spark):
    """files([(repo, path, content), ...]): list order becomes ``ord``."""
    def make(rows):
        return spark.createDataFrame(
            [(r, i, p, c) for i, (r, p, c) in enumerate(rows)], "repo_id string, ord bigint, path string, content string"
        )

    return make
