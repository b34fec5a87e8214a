import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return session


@pytest.fixture
def limits(spark):
    """Lower a size limit for one test, so the large-data path runs on small data."""
    changed = []

    def lower(name, value):
        spark.conf.set(f"spark.evalspark.{name}", str(value))
        changed.append(name)

    yield lower
    for name in changed:
        spark.conf.unset(f"spark.evalspark.{name}")
