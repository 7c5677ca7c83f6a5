import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from bandrisk.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = local_session(8, "bandrisk-tests", **{"spark.sql.warehouse.dir": str(warehouse)})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
