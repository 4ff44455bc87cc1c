import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from formwright.session import build

    top = tmp_path_factory.mktemp("spark")
    s = build("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{top}/checkpoints", "spark.sql.warehouse.dir": f"{top}/warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
