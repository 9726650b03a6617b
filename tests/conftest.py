import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lintel.session import get_spark
    s = get_spark("local[4]", app="lintel-tests", **{
        "spark.sql.shuffle.partitions": "8",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="lintel-test-ckpt-"),
    })
    yield s
    s.stop()
