import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from millrace.functions.session import local_session

    session = local_session(4, "4g", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    from millrace.sources import workspace

    workspace.clear(session)
    session.stop()


@pytest.fixture
def folder(spark, tmp_path):
    return f"file://{tmp_path}"
