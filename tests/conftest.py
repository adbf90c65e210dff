import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerlake.session import build_local_session, checkpoint_dir

    s = build_local_session("*", shuffle_partitions=8, app="ledgerlake-tests")
    if not s.sparkContext.getCheckpointDir() and not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlake-test-ckpt-"))
    checkpoint_dir(s)
    yield s
