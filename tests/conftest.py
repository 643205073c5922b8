import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from triagelake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shared"))
    session = local_session("4", "tests", **{"spark.checkpoint.dir": folder, "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())
