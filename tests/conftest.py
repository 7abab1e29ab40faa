import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sparktrace.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_log(spark):
    """Three cases, seconds from midnight: c1 A@0 B@3600 B@7200, c2 A@60 C@120, c3 B@10."""
    rows = [
        ("c1", "A", 0, 1), ("c1", "B", 3600, 2), ("c1", "B", 7200, 3),
        ("c2", "A", 60, 4), ("c2", "C", 120, 5), ("c3", "B", 10, 6),
    ]
    df = spark.createDataFrame(rows, "case_id string, activity string, s int, seq bigint")
    return df.selectExpr(
        "case_id", "activity", "timestampadd(SECOND, s, timestamp_ntz'2024-01-01 00:00:00') AS ts", "seq"
    )
