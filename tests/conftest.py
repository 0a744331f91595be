import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from brindle.session import session

    shared = str(tmp_path_factory.mktemp("shared"))
    found = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": shared, "spark.driver.memory": "4g"})
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
