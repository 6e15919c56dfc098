import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# The twelve-row fixture.
A = [1, 2, 2, 3, 4, 6, 3, 4, 5, 7, 8, 9]
B = [5, 3, 4, 4, 2, 3, 2, 1, 3, 1, 2, 0]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "2")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def mini(spark):
    rows = [(i, int(i > 5), float(a), float(b)) for i, (a, b) in enumerate(zip(A, B))]
    return spark.createDataFrame(rows, "id long, yd int, a double, b double").coalesce(2).cache()
