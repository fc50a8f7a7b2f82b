"""Session settings, the shared work folder and written intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A group larger than this is split over several tasks (see operators.ordered, operators.skew).
GROUP_ROWS = 2_000_000
GROUP_ROWS_KEY = "strataline.group_rows"
# What one task reads of a shuffle or of a file at most, as far as Spark can deal it out: sorts and hash aggregates of a task hold
# many times that.
SHUFFLE_BYTES, FILE_BYTES = 4 << 20, 32 << 20
SHUFFLE_BYTES_KEY = "strataline.shuffle_bytes"
ADVISORY, INITIAL = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
SPLIT = "spark.sql.files.maxPartitionBytes"


def configure(spark: SparkSession) -> SparkSession:
    """Runtime SQL settings the operators rely on. Only session-level settings are touched."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # split hot join partitions even where the next step then needs one more shuffle
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # shuffle partitions are merged, and files cut, up to these sizes only; a smaller setting of the session stays
    for key, most in ((ADVISORY, shuffle_bytes(spark)), (SPLIT, FILE_BYTES)):
        if _bytes(spark.conf.get(key)) > most:
            spark.conf.set(key, str(most))
    return spark


def _bytes(size: str) -> int:
    number, unit = re.fullmatch(r"(\d+) *([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")  # as Spark writes sizes: 64MB, 16m, 65536b


def shuffle_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get(SHUFFLE_BYTES_KEY, str(SHUFFLE_BYTES)))


def deal_out(spark: SparkSession, input_bytes: int) -> None:
    """Enough shuffle partitions for an input of this size, so that what one task sorts and aggregates does not grow with it.

    The number is only ever raised: adaptive execution merges what turns out small, but never splits a partition without a hot key.
    Columnar files are about half as large as the rows shuffled from them."""
    if spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true":
        now = int(spark.conf.get(INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions"))
        wanted = -(-2 * input_bytes // shuffle_bytes(spark))
        if wanted > now:
            spark.conf.set(INITIAL, str(wanted))


def stored_bytes(spark: SparkSession, path: str) -> int:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf).getContentSummary(at).getLength()


def group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_ROWS_KEY, str(GROUP_ROWS)))


def _checkpoint_base(spark: SparkSession) -> str:
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    if base:
        return base
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    sc.setCheckpointDir(base)
    return base


_handed_out: list[str] = []


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the cluster's checkpoint folder (a local one only under ``local[*]``)."""
    path = f"{_checkpoint_base(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _handed_out.append(path)
    return path


def clean_up(spark: SparkSession) -> int:
    """Delete the intermediate tables written so far in this process; returns their number. Call it when the results that read
    them are consumed: a DataFrame over a deleted table fails."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _handed_out:
        path = jvm.org.apache.hadoop.fs.Path(_handed_out.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and fixes values such as partition
    numbers. Columnar, so later steps read only the columns they need; one pass, and a lost executor
    costs nothing that was written."""
    # a column that is NULL everywhere and has no type yet is kept as text
    df = df.withColumns({c: df[f"`{c}`"].cast("string") for c, t in df.dtypes if t == "void"})
    path = shared_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
