import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from kpishift.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", 8, app="kpishift-tests")
    if not s.sparkContext.getCheckpointDir():
        folder = tempfile.mkdtemp(prefix="kpishift-test-ckpt-")
        s.conf.set("spark.checkpoint.dir", folder)
        s.sparkContext.setCheckpointDir(folder)
    yield s
    s.stop()
