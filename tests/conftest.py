import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master("local[2]").appName("tests")
    for key, value in (("spark.sql.shuffle.partitions", "4"), ("spark.ui.enabled", "false"), ("spark.sql.session.timeZone", "UTC"), ("spark.ui.showConsoleProgress", "false"), ("spark.driver.memory", "3g")):
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
