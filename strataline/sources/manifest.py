"""Read-file manifest and incremental runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extract, replace_first
from ..operators.skew import without_partner

SAMPLE_PATTERN = r"(N|P|AG|GM)-?\d{2,}"  # fixed value: sample ids in read-file names
LIBRARY_PATTERN = r"\d{8}"  # fixed value: library date in the folder name


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """``(path, length)`` of files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", glob).load(root).select("path", "length")


def read_manifest(files: DataFrame, group_id: str) -> DataFrame:
    """Pairs of read files with sample, library, lane and read-group text."""
    first = files.filter(F.col("path").contains("_R1_")).select(F.col("path").alias("r1"))
    first = first.withColumns({
        "sample": extract("r1", SAMPLE_PATTERN), "library": extract("r1", LIBRARY_PATTERN),
        "lane": F.element_at(F.split("r1", "/"), -2), "__r2": replace_first("r1", "R1", "R2")})
    group = F.concat(F.lit(f"@RG\\tID:{group_id}\\tLB:"), F.col("library"), F.lit("-"), F.col("lane"),
                     F.lit("\\tPL:ILLUMINA\\tSM:"), F.col("sample"))
    mates = files.select(F.col("path").alias("r2"))
    return first.withColumn("read_group", group).join(mates, F.col("__r2") == F.col("r2"), "left").drop("__r2")


def completed(outputs: DataFrame, keys: Sequence[str], kind: str, required: Sequence[str], size: str = "length") -> DataFrame:
    """Keys for which every required kind of output exists and is not empty."""
    flags = [F.max((F.col(kind) == k).cast("int")).alias(f"__{i}") for i, k in enumerate(required)]
    done = outputs.filter(F.col(size) > 0).groupBy(*keys).agg(*flags)
    for i in range(len(required)):
        done = done.filter(F.col(f"__{i}") == 1)
    return done.select(*keys)


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work whose keys are not completed yet."""
    return without_partner(work, done, keys)
