"""Sinks: CSV with chosen missing text, dated and per-cohort folders, fact tables, result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import run_date
from .readers import BOM


def write_csv(df: DataFrame, path: str, missing: str = "", bom: bool = False, mode: str = "overwrite") -> None:
    """CSV with header. ``bom=True`` starts every file with a byte-order mark (for spreadsheets)."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    df.write.mode(mode).option("header", True).option("nullValue", missing).option("emptyValue", "").option(
        "escape", '"').csv(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Parquet; with partitions only the written ones are replaced."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def write_dated(df: DataFrame, path: str, date: str | None = None) -> None:
    """Run-dated output: a rerun of the same date replaces its own folder only."""
    write_table(df.withColumn("run_date", run_date(date)), path, ["run_date"])


def write_cohorts(cohorts: dict[str, DataFrame], path: str) -> None:
    """Several cohorts in one data set, one partition per cohort."""
    parts = [d.withColumn("cohort", F.lit(name)) for name, d in cohorts.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    write_table(out, path, ["cohort"])


def tidy_results(results: DataFrame, family: str, by: Sequence[str] = (), numbers: Sequence[str] = ()) -> DataFrame:
    """Any test result as long rows ``(family, test_key, measure, value)``: the report table."""
    key = F.concat_ws("; ", *[F.concat(F.lit(f"{b}="), F.col(b).cast("string")) for b in by]) if by else F.lit("")
    names = list(numbers) or [c for c, t in results.dtypes if c not in by and t in ("double", "bigint", "int", "float")]
    flat = results.select(key.alias("test_key"), *[F.col(c).cast("double").alias(c) for c in names])
    return flat.unpivot(["test_key"], names, "measure", "value").select(
        F.lit(family).alias("family"), "test_key", "measure", "value")


def write_results(results: DataFrame, path: str) -> None:
    write_table(results, path, ["family"])


def write_jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str], partitions: int = 16) -> None:
    """Relational target; the number of partitions limits the connections. Needs a driver jar."""
    df.coalesce(partitions).write.mode("append").jdbc(url, table, properties=properties)
