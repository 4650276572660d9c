import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from legflow.session import local_session

    s = local_session("4", app="legflow-tests", extra={"spark.sql.shuffle.partitions": "8",
                                                       "spark.driver.memory": "4g"})
    yield s
    s.stop()
