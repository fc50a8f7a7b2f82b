"""Readers: everything lands as text or with a declared schema; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "NA"  # fixed value: text that means "missing" in the registry files
BOM = "﻿"


def text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lstrip(BOM) for c in df.columns])


def read_text_csv(spark: SparkSession, path: str | list[str], names: Sequence[str] | None = None, sep: str = ",",
                  packed: bool = False, missing: str = MISSING) -> DataFrame:
    """CSV with a header, every column text; ``NA`` and empty cells are NULL.

    ``packed=True`` allows line breaks inside quoted cells (such files are read one per task).
    """
    reader = spark.read.option("header", True).option("sep", sep).option("nullValue", missing).option(
        "escape", '"').option("multiLine", packed)
    df = reader.schema(text_schema(names)).csv(path) if names else _clean_names(reader.csv(path))
    return df.replace("", None)


def read_tsv(spark: SparkSession, path: str | list[str], names: Sequence[str] | None = None) -> DataFrame:
    return read_text_csv(spark, path, names, sep="\t")


def read_typed_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, sep: str = ",") -> DataFrame:
    """CSV with declared types; a row that does not fit keeps its text in ``_corrupt``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    return spark.read.schema(full).option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option(
        "nullValue", MISSING).option("columnNameOfCorruptRecord", "_corrupt").option("enforceSchema", True).csv(path)


def read_positional(spark: SparkSession, path: str | list[str], names: Sequence[str], sep: str = ",", skip: int = 1) -> DataFrame:
    """Columns named by position, all text. ``skip=1`` leaves out the first line of each file, ``skip=0`` reads it as a row."""
    if skip not in (0, 1):
        raise ValueError("skip is 0 or 1")
    return spark.read.schema(text_schema(names)).option("header", bool(skip)).option("sep", sep).option(
        "nullValue", MISSING).csv(path).replace("", None)


def subject_of_file(id_pattern: str, group: int = 0, whole_path: bool = False) -> Column:
    """Subject id from the name (or the whole path) of the file a row came from."""
    source = F.col("_metadata.file_path" if whole_path else "_metadata.file_name")
    found = F.regexp_extract(source, id_pattern, group)
    return F.when(found != "", found)


def read_subject_files(spark: SparkSession, path: str | list[str], names: Sequence[str], id_pattern: str,
                       subject: str = "id", sep: str = ",", group: int = 0, whole_path: bool = False) -> DataFrame:
    """All per-subject files in one scan; the subject id is taken from the file name."""
    df = spark.read.schema(text_schema(names)).option("header", True).option("sep", sep).option(
        "nullValue", MISSING).option("recursiveFileLookup", True).csv(path)
    return df.select("*", subject_of_file(id_pattern, group, whole_path).alias(subject))


def list_subjects(spark: SparkSession, path: str, id_pattern: str, subject: str = "id", group: int = 0,
                  whole_path: bool = False) -> DataFrame:
    """Subjects that have a file, also those whose file has no rows. File contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    source = F.col("path") if whole_path else F.element_at(F.split("path", "/"), -1)
    found = F.regexp_extract(source, id_pattern, group)
    return files.select(F.when(found != "", found).alias(subject)).distinct()


def read_chosen(spark: SparkSession, path: str, key: str, ids: Sequence[str] | DataFrame) -> DataFrame:
    """Rows of chosen ids from a table partitioned by id: only their folders are read.

    A list prunes at planning time; a frame prunes at run time through the join.
    """
    df = spark.read.parquet(path)
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias("__id")).distinct(),
                       F.col(key).cast("string") == F.col("__id").cast("string"), "left_semi")
    return df.filter(F.col(key).isin(list(ids)))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
