import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [p for p in (ROOT, os.path.join(ROOT, "tests")) if p not in sys.path]


@pytest.fixture(scope="session")
def spark():
    from lipikar.session import local_session

    session = local_session(8, "8g", spark_sql_warehouse_dir=tempfile.mkdtemp(prefix="lipikar-warehouse-"))
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"
