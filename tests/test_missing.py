"""Missing-value rules that differ from Spark's defaults."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from strataline.functions import missing, text
from strataline.functions.coding import bin_left_closed, bin_right_closed, safe_ratio
from strataline.operators import filters, joins, ordering, reshape
from strataline.operators.longitudinal import visit_table


def one(spark, column, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column.alias("y")).orderBy("i").collect()]


def test_choice_keeps_missing(spark):
    got = one(spark, missing.if_else3(F.col("x") == 1, F.lit("a"), F.lit("b")), [1, 0, None], "int")
    assert got == ["a", "b", None]


def test_membership(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert {r.x for r in filters.non_members(df, "x", ["a"]).collect()} == {"b", None}
    assert {r.x for r in filters.members(df, "x", ["a"]).collect()} == {"a"}


def test_missing_keys_match_in_joins(spark):
    a = spark.createDataFrame([(None, 1), ("k", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 10)], "k string, w int")
    assert {(r.k, r.w) for r in joins.left_join(a, b, ["k"], na_matches=True).collect()} == {(None, 10), ("k", None)}
    assert {(r.k, r.w) for r in joins.left_join(a, b, ["k"]).collect()} == {(None, None), ("k", None)}


def test_propagating_mean_and_sum(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", None)], "g string, x double")
    got = {r.g: (r.m, r.s) for r in df.groupBy("g").agg(missing.all_known_mean("x").alias("m"), missing.all_known_sum("x").alias("s")).collect()}
    assert got == {"a": (2.0, 4.0), "b": (None, None)}


def test_sort_puts_missing_last(spark):
    df = spark.createDataFrame([(None,), (2,), (1,)], "x int")
    assert [r.x for r in ordering.sort(df, "x").collect()] == [1, 2, None]
    assert [r.x for r in ordering.sort(df, "-x").collect()] == [2, 1, None]


def test_first_match_only(spark):
    assert one(spark, text.replace_first("x", "a", "-"), ["banana", "a\na", None]) == ["b-nana", "-\na", None]
    assert one(spark, text.remove_all("x", "a"), ["banana"]) == ["bnn"]


def test_zero_division_is_missing(spark):
    assert one(spark, safe_ratio("x", F.lit(0)), [1.0], "double") == [None]


def test_bins(spark):
    breaks = [1, 7, 14, 21, 28, float("inf")]
    assert one(spark, bin_right_closed("x", breaks), [0, 1, 7, 8, 14, 29], "int") == [None, "[1,7]", "[1,7]", "(7,14]", "(7,14]", "(28,Inf]"]
    assert one(spark, bin_left_closed("x", [1, 10, 20], ["a", "b"]), [0, 1, 9, 10, 20], "int") == [None, "a", "a", "b", None]


def test_missing_date_has_no_rank(spark):
    df = spark.createDataFrame([("a", "m", "2020-01-05", 1.0), ("a", "m", None, 2.0), ("a", "m", "2020-01-01", 3.0), ("a", "m", "2020-01-05", 4.0)],
                               "id string, measurement string, d string, measurement_value double")
    df = df.withColumns({"measurement_date": F.to_date("d"), "registration_date": F.to_date(F.lit("2020-01-01"))})
    got = {r["measurement_value"]: r for r in rows(visit_table(df, tie=["measurement_value"]))}
    assert [got[v]["rank"] for v in (3.0, 1.0, 4.0, 2.0)] == [1, 2, 2, None]
    assert got[3.0]["delta"] is None and got[1.0]["delta"] == -2.0
    assert got[1.0]["delta_per_year"] == pytest.approx(-2 / (4 / 365))
    assert got[4.0]["diff_btw_me"] == 0 and got[4.0]["delta_per_year"] is None


def test_packed_cells(spark):
    df = spark.createDataFrame([(1, "a\nb", "x"), (2, "a\nb\nc", "x\ny"), (3, None, "x")], "i int, p string, q string")
    got = sorted(map(tuple, reshape.unpack(df, ["p", "q"], mismatch="bad").collect()), key=str)
    assert got == sorted([(1, "a", "x", False), (1, "b", "x", False), (2, "a", "x", True), (2, "b", "y", True),
                          (2, "c", None, True), (3, None, "x", False)], key=str)


def test_duplicate_cell_is_an_error(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0)], "i int, k string, v double")
    with pytest.raises(Exception, match="duplicate cell"):
        reshape.to_wide(df, ["i"], "k", "v", ["a"]).collect()


def test_sentinels_and_numbers(spark):
    assert one(spark, missing.number(missing.null_if("x")), ["1.5", "ND", "-", "x", None, " 3 "]) == [1.5, None, None, None, None, 3.0]
    got = one(spark, missing.integer("x"), ["12.9", "-3.2", "abc"])
    assert got == [12, -3, None]
