import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import session

    made = session("local[4]", partitions=4, **{"spark.driver.memory": "4g", "spark.sql.files.openCostInBytes": "1048576"})
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
