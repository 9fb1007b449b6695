import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from fieldmark import session

    s = session.build("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    session.tune(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def inputs(spark):
    from fieldmark.plans.inputs import Inputs

    return Inputs(spark, SMALL)
