import os
import sys

import pytest
from pyspark.sql import SparkSession

from helpers import nested

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("redactlake-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def depot(spark):
    """A depot's gate code, item 12, with two other spellings."""
    from redactlake.operators.inventory import from_nested

    return from_nested(nested(spark, [(12, "(2)(B)(a)", "gate code", "7731-QX", [(1, "7731QX"), (4, "7731 qx")])]))
