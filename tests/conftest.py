import os
import sys
import tempfile

import pytest

os.environ.setdefault("TZ", "UTC")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from recordmill.session import local_session

    session = local_session("tests", cores=4, shuffle_partitions=3)
    # a handful of rows per test: compiling generated code would take most of the time
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="recordmill-test-"))
    yield session
    session.stop()
