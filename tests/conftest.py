import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lakekin.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    )
    session = configure(builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def countries(spark):
    """A ten-row table and the query whose match counts are known."""
    table = spark.createDataFrame(
        [
            ("Armenia", 3.7026666666666666, 44.70625, 29800.0),
            ("Colombia", 4.419333333333333, 49.54375, 1138910.0),
            ("Equatorial Guinea", 7.342, 17.85625, 28051.0),
            ("Germany", 11.628666666666668, 51.99375, 357021.0),
            ("Kazakhstan", 6.641333333333334, 45.15625, 2717300.0),
            ("Montenegro", 2.584285714285714, 50.4875, 5333.0),
            ("Nicaragua", 3.5966666666666667, 42.68125, 129494.0),
            ("Nigeria", 8.646666666666667, 19.75, 923768.0),
            ("Paraguay", 5.527333333333333, 39.525, 406750.0),
            ("United States of America", 8.579333333333333, 58.45, 3796742.0),
        ],
        "Country string, Alcohol double, BMI double, `Area(sq.mi.)` double",
    )
    query = spark.createDataFrame(
        [
            ("Armenia", 73.4),
            ("Colombia", 73.2875),
            ("Equatorial Guinea", 55.3125),
            ("Germany", 81.175),
            ("Kazakhstan", 66.7625),
            ("Montenegro", 74.5),
            ("Nicaragua", 73.45),
            ("Nigeria", 51.35625),
            ("Paraguay", 73.1125),
            ("United States of America", 78.0625),
        ],
        "Country string, `Life expectancy ` double",
    )
    return table, query
