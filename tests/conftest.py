import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from checks.session import local_session  # noqa: E402
from logsleuth.schema import AUTH_EVENTS  # noqa: E402

START = dt.datetime(2024, 6, 15, 10, 0, 0)


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("BENCH_CPUS", "8"), "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_events(spark):
    """Events from dicts with at (seconds or datetime) and any other column."""

    def make(rows, partitions=None):
        data = []
        for number, row in enumerate(rows):
            at = row.get("at", number)
            at = at if isinstance(at, dt.datetime) else START + dt.timedelta(seconds=at)
            data.append(
                (
                    "log",
                    row.get("line", number),
                    str(at),
                    at,
                    row.get("event", "FAILED_LOGIN"),
                    row.get("ip", "9.9.9.9"),
                    row.get("user", "bob"),
                    "sshd",
                    row.get("host", "web"),
                    row.get("message", "text"),
                    "raw",
                )
            )
        frame = spark.createDataFrame(data, AUTH_EVENTS)
        return frame.repartition(partitions) if partitions else frame

    return make


@pytest.fixture(scope="session")
def sf_events(spark):
    from logsleuth.sources.event_table import auth_events

    return auth_events(spark, "/root/testdata/sf0.001").cache()


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


@pytest.fixture(scope="session")
def rows_of():
    return rows
