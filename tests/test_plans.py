"""Composite flows on small registries."""

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataline.operators.regression import prepare_path_cohort, risk_flag_shares
from strataline.plans import battery, cohort, facts
from strataline.session import shared_dir
from strataline.sources import readers, writers


def test_coded_table(spark):
    names = ("TEST_DAY gender pet_result stool_text alcohol_a alcohol_b smoking_b family_history_dementia family_history weight height SBP DBP "
             "hypertension diabetes hyperlipidemia cardiac_disease stroke consent blood alcohol").split()
    kinds = {n: "int" for n in ("family_history_dementia", "hypertension", "diabetes", "hyperlipidemia", "cardiac_disease", "stroke")}
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)
    df = spark.createDataFrame([
        ("2020-01-01\n2020-02-01", "Male", "positive", "2020-03-01", "2", "3", "25", 1, "어머니, 아버지", "80", "200", "120", None, 0, 1, None, 0, 1, "O", "x", "Social"),
        (None, None, "unknown", "X", None, "3", "0", 0, "없음", "x", "200", None, "80", None, 0, 1, None, 0, None, "o", "none")], schema)
    a, b = rows(cohort.coded_table(df))
    assert (a["selection_num"], a["sex"], a["amyloid_PET_positivity"], a["stool"], a["stool_date"]) == (2, 1, 1, 1, "2020-03-01")
    assert (a["alcohol_c"], a["smoking_b"], a["fh_D"], a["bmi"], a["blood_pressure"]) == (6.0, "3", "3", 20.0, "120/NA")
    assert [a[x] for x in ("mh_H", "mh_D", "mh_L", "mh_C", "mh_S")] == [1, 2, 3, 1, 2]
    assert (a["consent"], a["blood"], a["alcohol"]) == (1, 0, 1)
    assert (b["selection_num"], b["sex"], b["amyloid_PET_positivity"], b["stool"], b["stool_date"]) == (None, None, None, 0, None)
    assert (b["alcohol_c"], b["smoking_b"], b["fh_D"], b["bmi"], b["blood_pressure"]) == (None, None, "", None, "NA/80")
    assert (b["consent"], b["blood"], b["alcohol"]) == (0, 1, 0)


def test_survey_staff(spark):
    staff = spark.createDataFrame([("a", "1", "조교수", None), ("b", "2", "간호사", None), ("c", "3", None, "홍보실장"), ("d", "08157", "간호사", None)], "name string, id string, position string, duty string")
    answers = spark.createDataFrame([("1.0",), ("9.0",)], "id string")
    got = {r["id"]: (r["name"], r["receive"], r["answer"]) for r in rows(cohort.survey_staff(staff, answers, ["08157"]))}
    assert got == {"1": ("a", "1", "1"), "3": ("c", "0", "0"), "08157": ("d", "0", "0"), "9": (None, "1", "1")}


def test_karyotype_rows(spark):
    raw = spark.createDataFrame([("k1", "'N_001", "남/70", "1", None), ("k2", None, "여/60", None, "1")], "no string, code string, sa string, x string, y string")
    got = rows(cohort.karyotype_rows(raw, {"code": "subject", "sa": "sex_age", "x": "xxx", "y": "turner"}, ["xxx", "turner"], "subject"))
    assert len(got) == 1
    assert (got[0]["subject"], got[0]["gender"], got[0]["age"], got[0]["xxx"], got[0]["turner"], got[0]["karyotype"]) == ("N_001", "Male", 70, 1.0, 0.0, True)


def test_variant_columns(spark):
    calls = spark.createDataFrame([("a", 1, "A>G"), ("a", 2, "C>T"), ("b", 1, "normal"), ("b", 2, "C>T"), ("c", 1, "A>G")], "id string, Coordinate int, Variant string")
    got = {r["id"]: r for r in rows(cohort.variant_columns(calls, "id", [1, 2], "t"))}
    assert [got[i]["t_all_present"] for i in "abc"] == [1, 0, None]
    assert got["b"]["t_coordinate_1_variant"] == "normal"


def test_method_rows_and_agreement(spark):
    # id, name, _, condition, _, onset, _, then date, e, rdrp, result per method
    def line(i, naso, saliva, date):
        return (str(i), "n", "x", "2020-01-01", "x", "2020-01-03", "x", date, "1", "1", naso, date, "1", "1", saliva)
    data = [line(1, "P", "P", "2020-01-05"), line(2, "P", "N", "2020-01-05"), line(3, "N", "N", "2020-01-20"), line(4, "N", "N", "2020-01-20")]
    wide = spark.createDataFrame(data + [(*line(5, "P", "P", "2020-01-05")[:-1], None)], [f"X{i}" for i in range(1, 16)])
    long = battery.method_rows(wide, {"naso": 8, "saliva": 12})
    assert long.count() == 8 and {r["result"] for r in rows(long.filter("id = '2'"))} == {"P", "N"}
    got = {(r["base"], r["bin"]): r for r in rows(battery.agreement_battery(long, "saliva", ["naso"], ["method_date"]))}
    assert got["all", "all"]["n"] == 4 and got["all", "all"]["percent_agreement"] == 75
    assert got["condition", "[1,7]"]["n"] == 2 and got["condition", "[1,7]"]["percent_agreement"] == 50
    assert got["condition", "(14,21]"]["percent_agreement"] == 100 and got["condition", "(14,21]"]["kappa"] is None
    assert got["onset", "[1,7]"]["n"] == 2 and got["onset", "(14,21]"]["n"] == 2


def test_prepare_path_cohort(spark):
    raw = spark.createDataFrame([("1", "70", "1", "C50", "0", "#N/A"), ("2", "x", "0", "#N/A", "2", "5")], "row string, a string, b string, c string, d string, e string")
    got = rows(prepare_path_cohort(raw, ["age", "htn", "ca_icd", "ca_ctx", "ca_ht"], ["age"], ["htn"], {"ca": "ca_icd"}, {"ca_ctx": "ca_ctx", "ca_ht": "ca_ht"}))
    assert (got[0]["age"], got[0]["htn"], got[0]["ca"], got[0]["ca_ctx"], got[0]["ca_ht"]) == (70.0, True, True, False, False)
    assert (got[1]["age"], got[1]["htn"], got[1]["ca"], got[1]["ca_ctx"], got[1]["ca_ht"]) == (None, False, False, True, True)


def test_packed_measurements(spark):
    wide = spark.createDataFrame([("p", "20\nND\n22", "2020-01-01\n2020-02-01\n2020-03-01"), ("q", None, "2020-01-01"), ("r", "5", None)], "id string, MMSE string, d string")
    got = [tuple(r) for r in facts.packed_measurements(wide, "id", {"MMSE": ("d", "Mini")}).orderBy("measurement_date").collect()]
    assert [(g[0], g[1], str(g[2]), g[3]) for g in got] == [("p", "Mini", "2020-01-01", "20"), ("p", "Mini", "2020-03-01", "22")]


def test_risk_flag_shares(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (0, 1, 1), (1, None, 1)], "e int, m int, y int")
    got = {(r["flag"], r["target"], r["level"]): (r["n"], r["proportion"]) for r in rows(risk_flag_shares(df, "y", "e", "m"))}
    assert got["e", "y", 1] == (1, .5) and got["m", "y", 1] == (2, 1.0) and got["interaction", "interaction", 1] == (1, 1.0)


def test_corrupt_rows_are_kept_aside(spark):
    path = shared_dir(spark, "t")
    writers.write_csv(spark.createDataFrame([("1", "2.5"), ("x", "3.5"), ("NA", "NA")], "i string, v string"), path)
    schema = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", T.DoubleType())])
    got = rows(readers.read_typed_csv(spark, path, schema).cache())
    assert sum(g["_corrupt"] is not None for g in got) == 1 and len(got) == 3


def test_byte_order_mark(spark):
    path = shared_dir(spark, "t")
    writers.write_csv(spark.createDataFrame([("가", None)], "`이름` string, b string").coalesce(1), path, missing="NULL", bom=True)
    raw = spark.read.format("binaryFile").load(path + "/*.csv").first().content
    assert bytes(raw).startswith(b"\xef\xbb\xbf") and b"NULL" in bytes(raw)
    back = readers.read_text_csv(spark, path, missing="NULL")
    assert back.columns == ["이름", "b"] and tuple(back.first()) == ("가", None)


def test_condition_battery_with_visits(spark):
    people = spark.createDataFrame([(i, i % 2, float(i), "MF"[i % 3 == 0]) for i in range(20)], "id int, c int, age double, gender string")
    visits = people.select("id", "c", F.lit("MMSE").alias("measurement"), (F.col("age") * 2).alias("measurement_value"), F.lit(1).alias("rank"))
    got = {(r["variable"], r["test"]): r for r in rows(battery.condition_battery(people, "c", ["age"], ["gender"], visits=visits))}
    assert set(got) == {("age", "t"), ("gender", "chi_squared"), ("MMSE", "t")}
    assert got["MMSE", "t"]["statistic"] == pytest.approx(got["age", "t"]["statistic"])


def test_strata_battery_with_visits(spark):
    people = spark.createDataFrame([(i, i % 2, (i // 2) % 2, float(i % 7), ["Male", "Female", None][i % 3], i % 5 > 2) for i in range(60)],
                                   "id int, turner int, dementia int, age double, gender string, e4 boolean")
    visits = people.select("id", "turner", "dementia", "gender", F.lit("MMSE").alias("measurement"), F.col("age").alias("measurement_value"),
                           F.lit(1).alias("rank"), (F.col("age") * 3).alias("delta_per_year"))
    got = {(r["dementia"], r["gender"], r["variable"]): r for r in rows(
        battery.strata_battery(people, ["turner"], ["age"], ["e4"], "dementia", "gender", visits=visits))}
    assert {k[1] for k in got} == {"All genders", "Male", "Female"}
    # visits are compared over all genders only, and a missing gender counts there
    assert {k[1] for k in got if k[2] in ("MMSE", "change in MMSE")} == {"All genders"}
    whole, first = got[1, "All genders", "age"], got[1, "All genders", "MMSE"]
    assert whole["n"] == first["n"] == 30 and whole["statistic"] == pytest.approx(first["statistic"])
    assert got[1, "All genders", "change in MMSE"]["statistic"] == pytest.approx(first["statistic"])
    assert got[1, "Male", "e4"]["n"] == 10


def test_box_numbers_of_everything(spark):
    from strataline.operators.charts import box_numbers, box_outliers
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5, 100)], "x double")
    got = rows(box_numbers(df, "x"))[0]
    assert (got["n"], got["median"], got["whisker_low"], got["whisker_high"], got["n_outliers"]) == (6, 3.5, 1.0, 5.0, 1)
    assert [tuple(r) for r in box_outliers(df, "x").collect()] == [(100.0, 1)]


def test_written_tables_keep_untyped_columns(spark):
    from strataline.session import materialise
    out = materialise(spark.range(2).withColumn("empty", F.lit(None)))
    assert dict(out.dtypes)["empty"] == "string" and out.filter("empty IS NULL").count() == 2
