import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from webloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    conf = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "4g", "spark.checkpoint.dir": shared, "spark.sql.warehouse.dir": f"{shared}/warehouse"}
    session = build_session("webloom-tests", "8", **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
