"""One small Spark session for all tests."""

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidegrid.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_session("tests", 4, **{"spark.sql.shuffle.partitions": "2", "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1", "spark.driver.memory": "3g", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def day():
    return lambda text: dt.date.fromisoformat(text)


@pytest.fixture(scope="session")
def at():
    return lambda text: dt.datetime.fromisoformat(text)


def rows(df):
    """Rows as a sorted list of tuples; None sorts first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is not None, str(v)) for v in t))
