import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from quillstone.session import local_session, ship

    session = local_session(8, 2, **{"spark.driver.memory": "4g", "spark.default.parallelism": "2", "spark.sql.adaptive.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield ship(session)
    session.stop()
