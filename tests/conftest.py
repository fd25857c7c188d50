import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from logsift.session import checkpoint_root, get_spark
    s = get_spark(master="local[8]", app="logsift-tests", shuffle_partitions=8,
                  extra={"spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_root(s)
    yield s
