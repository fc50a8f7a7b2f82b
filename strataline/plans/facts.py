"""Person, measurement and observation facts from a wide registry."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.dates import lenient_date
from ..functions.missing import number
from ..operators.joins import enrich
from ..operators.reshape import constant_table, stack, to_long, unpack


def person_facts(wide: DataFrame, person: str, gender: str, birth_date: str) -> DataFrame:
    sex = F.when(F.col(gender) == "M", "Male").when(F.col(gender) != "M", "Female")
    return wide.filter(F.col(person).isNotNull()).select(
        F.col(person).alias("person_id"), sex.alias("gender"), F.col(birth_date).alias("birth_date"))


def packed_measurements(wide: DataFrame, person: str, packed: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Packed value cells to facts. ``packed`` maps value column to (date column, concept name)."""
    parts = []
    for value, (date, concept) in packed.items():
        rows = unpack(wide.select(F.col(person).alias("person_id"), F.col(value).alias("value_as_number"),
                                  F.col(date).alias("measurement_date")), ["value_as_number", "measurement_date"])
        parts.append(rows.select("person_id", F.lit(concept).alias("measurement_concept"),
                                 lenient_date("measurement_date").alias("measurement_date"), "value_as_number"))
    return stack(*parts).na.drop().filter(F.col("value_as_number") != "ND")


def vital_measurements(wide: DataFrame, person: str, date: str, columns: Mapping[str, str] = V.VITAL_CONCEPTS) -> DataFrame:
    """One column per vital sign to facts. ``columns`` maps source column to concept name."""
    named = wide.select(F.col(person).alias("person_id"), F.col(date).alias("measurement_date"),
                        *[F.col(c).cast("string").alias(n) for c, n in columns.items()])
    long = to_long(named, ["person_id", "measurement_date"], list(columns.values()), "measurement_concept", "value_as_number")
    return long.na.drop().select("person_id", "measurement_concept", "measurement_date", "value_as_number")


def observation_texts(wide: DataFrame, person: str, date: str, columns: Mapping[str, str] | None = None) -> DataFrame:
    """True history flags to facts with the concept and text of the lookup table.

    ``columns`` maps source column to the key of ``OBSERVATION_CONCEPTS`` (same names by default).
    """
    columns = columns or {k: k for k in V.OBSERVATION_CONCEPTS}
    named = wide.select(F.col(person).alias("person_id"), F.col(date).alias("observation_date"),
                        *[F.col(c).cast("boolean").alias(k) for c, k in columns.items()])
    long = to_long(named, ["person_id", "observation_date"], list(columns.values()), "key", "value")
    lookup = constant_table(wide.sparkSession, V.OBSERVATION_CONCEPTS, ["key", "observation_concept", "value_as_string"])
    true = long.filter(F.col("person_id").isNotNull() & F.col("value"))
    return enrich(true, lookup, ["key"]).select("person_id", "observation_concept", "observation_date", "value_as_string")


def observation_numbers(wide: DataFrame, person: str, date: str, value: str, concept: str = "Years of education") -> DataFrame:
    return wide.select(F.col(person).alias("person_id"), F.lit(concept).alias("observation_concept"),
                       F.col(date).alias("observation_date"), number(value).alias("value_as_number")).na.drop()
