import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def two_samples(spark):
    """Builds (scenario, x) from a baseline and a batch list."""

    def build(base, prod, **more):
        rows = [("Baseline", None if v is None else float(v)) for v in base]
        rows += [("P", None if v is None else float(v)) for v in prod]
        for name, values in more.items():
            rows += [(name, float(v)) for v in values]
        return spark.createDataFrame(rows, "scenario string, x double")

    return build
