import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from millrace.session import session

    folder = tmp_path_factory.mktemp("spark")
    spark = session("tests", "local[4]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false", spark__driver__memory="4g", spark__checkpoint__dir=f"file://{folder}/checkpoints", spark__sql__warehouse__dir=f"{folder}/warehouse")
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
