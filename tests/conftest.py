import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from tabstrata.runtime import ship_package

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def train(spark, small):
    """Cached training frame with the standardised numeric features."""
    from tabstrata.operators.scale import StandardScaler
    from tabstrata.plans.fixtures import training_frame
    from tabstrata.sources.tables import NUMERIC

    df = training_frame(spark, small)
    out = StandardScaler(NUMERIC).fit(df).transform(df).persist()
    out.count()
    return out
