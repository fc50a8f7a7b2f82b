"""What a task reads of a shuffle stays the same when the tables grow."""

import pytest

from pyspark.sql import functions as F

from strataline import session
from strataline.catalog.registry import Tables

KEYS = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.maxPartitionBytes")


@pytest.fixture
def settings(spark):
    before = {k: spark.conf.get(k, None) for k in KEYS}
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_shuffles_are_dealt_out_by_the_size_of_the_tables(settings, tmp_path):
    spark = settings
    for k in KEYS:
        spark.conf.unset(k)
    spark.conf.set("strataline.shuffle_bytes", str(1 << 20))
    try:
        for name, rows in (("small", 1000), ("large", 1_200_000)):
            spark.range(rows, numPartitions=4).select("id", F.md5(F.col("id").cast("string")).alias("x")).write.parquet(f"{tmp_path}/{name}.parquet")
        session.configure(spark)
        t = Tables(spark, str(tmp_path))
        tasks = {n: getattr(t, n).groupBy("id").agg(F.max("x")).rdd.getNumPartitions() for n in ("small", "large")}
        assert tasks["small"] <= 8 < 30 < tasks["large"], tasks  # 8 shuffle partitions are set; 40 MB are read at most 1 MB a task
        assert int(spark.conf.get(KEYS[2])) <= session.FILE_BYTES
    finally:
        spark.conf.unset("strataline.shuffle_bytes")


@pytest.mark.parametrize("given", ["16k", "64k", "1048576b", "2MB"])
def test_smaller_settings_of_the_session_stay(settings, given):
    settings.conf.set(KEYS[0], given)
    session.configure(settings)
    assert settings.conf.get(KEYS[0]) == given
