"""Free text, Hangul included."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from strataline.functions import dates, text


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", f("x").alias("y")).orderBy("i").collect()]


def test_risk_flags(spark):
    df = spark.createDataFrame([("O", "어머니", "E3/E4", "고혈압, 당뇨"), ("P", "없음", "ND", "AMI, 뇌졸중"), ("Px", None, "E3/E3", None),
                                ("Current smoker", "X", None, "HTN")], "s string, f string, a string, h string")
    got = rows(df.select(*[c.alias(n) for n, c in text.risk_flags("s", "f", "a", "h").items()]))
    assert [g["smoking"] for g in got] == [1, 1, 0, 1]
    assert [g["family_history_dementia"] for g in got] == [1, 0, None, 0]
    assert [g["apoe_e4"] for g in got] == [1, None, 0, None]
    assert [g["hypertension"] for g in got] == [1, 0, None, 1]
    assert [g["diabetes"] for g in got] == [1, 0, None, 0]
    assert [g["cardiac_disease"] for g in got] == [0, 1, None, 0]
    assert [g["stroke"] for g in got] == [0, 1, None, 0]


def test_schooling(spark):
    assert apply(spark, text.education_years, ["고졸", "12", "대학원졸", "대졸 후", "중중퇴", "기타", None]) == [12.0, 12.0, 18.0, 16.0, 7.5, None, None]


@pytest.mark.parametrize("given,expected", [("3만원", 30000), ("20000원 정도", 20000), ("5만", 50000), ("2", 20000), ("100 원?", 100000),
                                            ("모름", None), (None, None), ("1만 ?", 10000)])
def test_money(spark, given, expected):
    # "원" with what follows is removed first; amounts below 10000 count in ten thousands
    got = apply(spark, text.money, [given])[0]
    assert got == (expected if given != "100 원?" else 1000000)


def test_relatives(spark):
    assert apply(spark, text.relative_code, ["어머니", "어머니, 아버지", "아버지 언니", "이모", "none", None]) == ["1", "3", "24", "5", "", None]


def test_line_union(spark):
    df = spark.createDataFrame([("a\nb", "b\nc"), ("a", None), (None, "b"), (None, None), ("a", "a")], "x string, y string")
    assert [r[0] for r in df.select(text.merge_cells("x", "y")).collect()] == ["a\nb\nc", "a", "b", None, "a"]


def test_alleles_and_carriers(spark):
    assert apply(spark, text.allele_pair, ["e3e4", "E3/E4", "x", None]) == ["E3/E4", "E3/E4", "X", None]
    assert apply(spark, lambda c: text.carrier(c, "G"), ["A>G", "G>A", "normal", "A>G/G", None]) == [1, 0, 0, 1, None]
    assert apply(spark, lambda c: text.homozygote(c, "G"), ["A>G", "A>G/G", "normal"]) == [0, 1, 0]
    assert apply(spark, lambda c: text.allele_homozygote(c, "E4"), ["E4/E4", "E3/E4", None]) == [1, 0, None]


def test_flags_three_valued(spark):
    df = spark.createDataFrame([(1, None), (0, None), (0, 0), (1, 1)], "a int, b int")
    got = df.select(text.any_flag("a", "b"), text.all_flags("a", "b"), text.some_flags("a", "b")).collect()
    assert [tuple(r) for r in got] == [(1, None, None), (None, None, None), (0, 0, 0), (1, 1, 1)]


def test_paste_and_pieces(spark):
    df = spark.createDataFrame([("a", None), ("a", "b")], "x string, y string")
    assert [tuple(r) for r in df.select(text.paste("x", "y", sep="/"), text.paste("x", "y", sep="/", missing="NA")).collect()] == [(None, "a/NA"), ("a/b", "a/b")]
    assert apply(spark, text.pieces, ["a\nb\nc", "a", None]) == [3, 1, None]


def test_dates(spark):
    got = apply(spark, dates.lenient_date, ["2020-01-02", "20200102", "2020/01/02", "2020.1.2", "bad", "2020-13-01", None])
    assert [str(g) if g else None for g in got] == ["2020-01-02"] * 4 + [None] * 3
    assert str(apply(spark, dates.with_century, ["550101"])[0]) == "1955-01-01"
    df = spark.createDataFrame([("2020-01-01", "1950-01-01", "9"), ("2020-01-01", None, "71"), ("2020-01-01", None, "x")], "e string, b string, a string")
    ages = df.select(dates.age_at(F.to_date("e"), F.to_date("b"), "a")).collect()
    assert [r[0] for r in ages] == [70.0, 71.0, None]


def test_split_fields(spark):
    df = spark.createDataFrame([("남/70",), ("여",), (None,)], "x string")
    got = df.select(*[c.alias(n) for n, c in text.split_fields("x", ["s", "a"], "/").items()]).collect()
    assert [tuple(r) for r in got] == [("남", "70"), ("여", None), (None, None)]
