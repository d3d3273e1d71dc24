import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from evidor.session import session

    spark = session(8, 4, spark__driver__memory="6g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
                    spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def sf():
    return "/root/testdata/sf0.001"
