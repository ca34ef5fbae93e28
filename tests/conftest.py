import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cmdlens.session import local_session  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=8, shuffle_partitions=8, app_name="cmdlens-tests")
    yield s


def make_events(spark, rows):
    """rows: (event_id, cmd, cwd, ts_ms[, source, tool, category])"""
    full = [tuple(r) + ("",) * (7 - len(r)) for r in rows]
    return spark.createDataFrame(
        full, "event_id long, cmd string, cwd string, ts_ms long, source string, tool string, category string")


def make_history(spark, rows):
    from cmdlens.operators.ingest import ingest
    return ingest(make_events(spark, rows))
