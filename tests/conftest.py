import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from growthlens.session import checkpoint_dir, get_spark
    s = get_spark(app="growthlens-tests", master="local[*]", shuffle_partitions=8,
                  extra={"spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s


SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
