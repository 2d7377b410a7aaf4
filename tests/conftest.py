import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from itemscope.session import get_spark
    s = get_spark(master="local[4]", conf={"spark.sql.shuffle.partitions": "4",
                                           "spark.driver.memory": "8g"})
    yield s
    s.stop()
