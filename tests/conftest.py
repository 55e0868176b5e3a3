import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(shared))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def sample(spark):
    """A busy machine seen in the evening and in the morning, and a quiet one seen in the evening."""
    seen = {"alpha": [("20:10", 30.0), ("20:40", 34.0), ("21:05", 38.0), ("09:30", 70.0), ("10:30", 90.0)], "beta": [("22:00", 5.0), ("23:30", 7.0)]}
    rows = [(f"2025-03-07 {at}:00", name, "mail", value, 0) for name, values in seen.items() for at, value in values]
    df = spark.createDataFrame(rows, "timestamp string, machine string, type string, cpu double, label int")
    return df.withColumn("timestamp", df.timestamp.cast("timestamp_ntz"))
