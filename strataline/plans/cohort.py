"""Cohort build: registries to typed rows, linked people, one merged master table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coding, dates, text
from ..functions import vocabulary as V
from ..functions.missing import null_if, number
from ..operators.columns import move, rename
from ..operators.filters import drop_missing
from ..operators.joins import coalesce_join, left_join
from ..operators.reshape import stack
from ..session import materialise


def registry_rows(patients: DataFrame, controls: DataFrame, names: Mapping[str, str], number_column: str,
                  century: str | None = None) -> DataFrame:
    """One registry: patients (outcome 1) and controls (0) with common names, sex, birth date and age.

    ``names`` maps source columns to ``registration_date``, ``gender``, ``birth_date``, ``age`` and
    the like; ``century`` completes two-digit years. Rows without registry number are dropped.
    """
    rows = stack(patients.withColumn("dementia", F.lit(1)), controls.withColumn("dementia", F.lit(0)))
    rows = rename(rows, names)
    birth = dates.with_century("birth_date", century) if century else dates.lenient_date("birth_date")
    registered = dates.lenient_date("registration_date")
    out = rows.withColumns({
        number_column: text.replace_first(number_column, "_", "-"), "gender": text.recode("gender", V.SEX_NAMES),
        "birth_date": birth.cast("string"),
        "age_new": F.when(F.col("birth_date").isNull(), number("age")).otherwise(dates.age_at(registered, birth))})
    if "visit_date" in out.columns:
        out = out.withColumn("visit_date", null_if("visit_date", ["-"]))
    return drop_missing(out, [number_column])


def add_risk_flags(rows: DataFrame, smoking="smoking_text", family="family_history", apoe="ApoE", history="history",
                   education: str | None = "education") -> DataFrame:
    out = rows.withColumns(text.risk_flags(smoking, family, apoe, history))
    if education:
        known = "education_year" if "education_year" in rows.columns else None
        out = out.withColumn("education_year", text.education_years(education, known))
    return out


def karyotype_rows(raw: DataFrame, names: Mapping[int | str, str], flags: Sequence[str], subject: str,
                   sex_age: str = "sex_age") -> DataFrame:
    """Karyotype list: sex and age split, flags filled with 0, id without its leading quote."""
    rows = drop_missing(rename(raw, names), [subject])
    rows = rows.withColumns(text.split_fields(sex_age, ["gender", "age"], "/")).drop(sex_age)
    return rows.withColumns({
        subject: text.remove_first(subject, "'"), "gender": text.recode("gender", V.SEX_NAMES),
        "age": number("age").cast("int"), "karyotype": F.lit(True),
        **{f: F.coalesce(number(f), F.lit(0.0)) for f in flags}})


def variant_columns(calls: DataFrame, subject: str, coordinates: Sequence[int], prefix: str = "top3b") -> DataFrame:
    """Variant text per listed coordinate and the all-present flag, one row per subject.

    The flag is missing when any of the coordinates has no row for the subject.
    """
    at = lambda c, v: F.max(F.when(F.col("Coordinate") == c, v))
    present = F.when(F.col("Variant") == V.NORMAL, 0).otherwise(1)
    out = calls.filter(F.col("Coordinate").isin(list(coordinates))).groupBy(subject).agg(
        *[at(c, F.col("Variant")).alias(f"{prefix}_coordinate_{c}_variant") for c in coordinates],
        *[at(c, present).alias(f"{prefix}_coordinate_{c}") for c in coordinates])
    return out.withColumn(f"{prefix}_all_present", text.all_flags(*[f"{prefix}_coordinate_{c}" for c in coordinates]))


def with_key(rows: DataFrame, keys: DataFrame, number_column: str) -> DataFrame:
    """Add the person key by registry number; an unknown number keeps no key."""
    known = keys.filter(F.col(number_column).isNotNull()).select(number_column, "key_id")
    return left_join(rows, known, [number_column], na_matches=False)


def master_table(first: DataFrame, others: Sequence[DataFrame], key: str = "key_id", front: Sequence[str] = (),
                 na_matches: bool = False, write_steps: bool = True) -> DataFrame:
    """Merge all sources into the first one by person key and put the id columns first.

    Rows without a key stay apart; ``na_matches=True`` matches them with each other, as in the scripts
    (their number of pairs grows with the product). Each step is written once to the shared
    folder, because the next one reads it twice (measured, then joined).
    """
    def step(a: DataFrame, b: DataFrame) -> DataFrame:
        merged = coalesce_join(a, b, [key], na_matches)
        return materialise(merged) if write_steps else merged
    out = reduce(step, others, first)
    return move(out, [c for c in front if c in out.columns])


def coded_table(master: DataFrame) -> DataFrame:
    """Survey codes of the master table: visit count, sex, PET, stool, alcohol, smoking, relatives,
    body-mass index, blood pressure text and no / yes / unknown histories."""
    c = F.col
    numeric = {x: number(x) for x in ("alcohol_a", "alcohol_b", "weight", "height")}
    stool = c("stool_text").isNotNull() & (c("stool_text") != "X")
    histories = {"mh_H": "hypertension", "mh_D": "diabetes", "mh_L": "hyperlipidemia", "mh_C": "cardiac_disease", "mh_S": "stroke"}
    return master.withColumns(numeric).withColumns({
        "selection_num": text.pieces("TEST_DAY"),
        "sex": text.recode("gender", V.SEX_NUMBERS, keep=False),
        "amyloid_PET_positivity": text.recode("pet_result", {"positive": 1, "negative": 0}, keep=False),
        "stool": F.when(stool, 1).otherwise(0), "stool_date": F.when(stool, c("stool_text")),
        "alcohol_c": c("alcohol_a") * c("alcohol_b"),
        "smoking_b": coding.smoking_code("smoking_b"),
        "fh_D": F.when(c("family_history_dementia") == 1, text.relative_code("family_history")).when(
            c("family_history_dementia") == 0, ""),
        "bmi": coding.body_mass_index("weight", "height"),
        "blood_pressure": text.paste("SBP", "DBP", sep="/", missing="NA"),
        **{new: text.no_yes_unknown(old) for new, old in histories.items()},
        "consent": text.answered("consent", "o"), "blood": text.answered("blood", "o"),
        "alcohol": text.answered("alcohol", "^o|^p|social", "^x|^n")})


def survey_staff(staff: DataFrame, answers: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """Staff of listed positions, duties or ids, with what was received and answered."""
    from ..operators.filters import match_any
    from ..operators.joins import full_join_first_known
    chosen = match_any(staff, {"position": V.POSITION_PATTERN, "duty": V.DUTY_PATTERN}, "id", ids)
    marked = answers.select(text.remove_first("id", r"\.0$").alias("id"), F.lit("1").alias("receive"), F.lit("1").alias("answer"))
    return full_join_first_known(chosen, marked, ["id"], na_matches=False).na.fill({"receive": "0", "answer": "0"})
