import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from jobscope.session import local_session
    s = local_session("*", shuffle_partitions=8, app="jobscope-tests",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="jobscope-ckpt-")})
    yield s
    s.stop()


@pytest.fixture()
def scratch(spark):
    """A fresh folder under the session's shared folder."""
    from jobscope.session import scratch_path
    return scratch_path(spark, "test")
