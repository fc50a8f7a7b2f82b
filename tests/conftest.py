import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    from strataline.session import configure
    configure(session)
    yield session
    from strataline.session import clean_up
    clean_up(session)
    session.stop()


@pytest.fixture
def small_groups(spark):
    """Force the split paths: every group above a handful of rows counts as too large."""
    from strataline.session import GROUP_ROWS_KEY
    spark.conf.set(GROUP_ROWS_KEY, "7")
    yield 7
    spark.conf.unset(GROUP_ROWS_KEY)


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def rows(df):
    return [r.asDict() for r in df.collect()]
