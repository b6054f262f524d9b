import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from codeloom.session import get_spark
    s = get_spark("local[4]", conf={"spark.sql.shuffle.partitions": "8"})
    yield s


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="codeloom-test-")


SF_SMALL = "/root/testdata/sf0.001"
