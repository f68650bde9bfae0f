from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelyst.operators import clean as C
from panelyst.operators import columns as K
from panelyst.operators import recode as R


def test_token_scrub_needs_five_dots(spark, rows):
    df = spark.createDataFrame([("a.....",), ("....",), (None,), ("b",)], "t string")
    assert rows(C.token_to_null(df)) == sorted([("....",), ("b",), (None,), (None,)], key=lambda r: (r[0] is None, r))


def test_remap_happens_before_scrub(spark):
    df = spark.createDataFrame([(99,), (98,), (9,), (None,)], "x int")
    out = C.remap_then_scrub(df, ["x"], {99: 0}, 9, "_RC")
    assert [r["x_RC"] for r in out.collect()] == [0, None, 9, None]


def test_correct_where_ands_all_conditions(spark):
    df = spark.createDataFrame([(10, "0020", -1), (10, "0021", -1), (10, "0020", 30), (10, None, -1)], "s int, p string, a int")
    out = C.correct_where(df, "a", 19, (F.col("s") == 10) & (F.col("p") == "0020") & (F.col("a") == -1))
    assert [r["a"] for r in out.collect()] == [19, -1, 30, -1]


def test_split_valid_partitions_rows(spark):
    df = spark.createDataFrame([(1,), (None,), (5,)], "x int")
    valid, rejects = C.split_valid(df, F.col("x") > 3)
    assert valid.count() == 2 and rejects.count() == 1


def test_binary_and_answered_rows(spark):
    df = spark.createDataFrame([(0, 1), (1, 9), (None, 1), (None, None)], "a int, b int")
    assert C.binary_rows(df, ["a", "b"]).count() == 1
    assert C.answered_rows(df, ["a", "b"]).count() == 3
    assert C.complete_rows(df).count() == 2


def test_without_levels_keeps_null(spark):
    df = spark.createDataFrame([("Skipped",), ("yes",), (None,)], "t string")
    assert C.without_levels(df, "t").count() == 2


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "SITE1 int, mtuex1 int, MTUEX2 int, other int")
    assert K.starting_with(df, "MTU") == ["mtuex1", "MTUEX2"]
    assert K.containing(df, "TUEX") == ["mtuex1", "MTUEX2"]
    assert K.matching(df, r"\d$") == ["SITE1", "mtuex1", "MTUEX2"]
    assert K.between(df, "mtuex1", "other") == ["mtuex1", "MTUEX2", "other"]
    assert K.existing(df, ["other", "none"]) == ["other"]
    assert K.shared(df, ["other", "SITE1", "x"]) == ["SITE1", "other"]
    assert K.numbered("HE", [1, 10], 2, "_RC") == ["HE01_RC", "HE10_RC"]
    assert K.key_first(df, "other").columns == ["other", "SITE1", "mtuex1", "MTUEX2"]
    assert K.drop_between(df, "mtuex1", "other").columns == ["SITE1"]


def test_data_dependent_drops(spark):
    df = spark.createDataFrame([(0, None, 0, 1), (0, None, None, 0)], "z int, n int, zn int, v int")
    assert K.drop_all_null(df).columns == ["z", "zn", "v"]
    # A NULL keeps a column that is otherwise all 0; an all-NULL column is not all 0.
    assert K.drop_all_zero(df).columns == ["n", "zn", "v"]


def test_reshape_round_trip(spark, rows):
    df = spark.createDataFrame([("p", 1, 2), ("q", 3, None)], "k string, a int, b int")
    long = K.to_long(df, ["k"], ["a", "b"], "name", "v")
    assert rows(K.to_wide(long, ["k"], "name", "v", ["a", "b"])) == rows(df)


def test_recode_keeps_unlisted_and_null(spark):
    df = spark.createDataFrame([(1,), (2,), (7,), (None,)], "x int")
    got = [r[0] for r in df.select(R.recode("x", {1: "A", 2: "A"})).collect()]
    assert got == ["A", "A", "7", None]


def test_ladder_passes_over_unknown(spark):
    df = spark.createDataFrame([(None, 1), (1, 0), (0, 0)], "a int, b int")
    rule = R.ladder([(F.col("a") == 1, "first"), (F.col("b") == 1, "second")], "else")
    assert [r[0] for r in df.select(rule).collect()] == ["second", "first", "else"]


def test_dummies_sum_to_one_and_keep_null(spark):
    df = spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "t string")
    out = df.select(*[c.alias(n) for n, c in R.dummies("t", "T", {"X": "x", "YZ": ("y", "z")}, "X").items()])
    assert out.columns == ["T_RCR_X", "T_RCD_YZ"]
    assert [tuple(r) for r in out.collect()] == [(1, 0), (0, 1), (0, 1), (None, None)]


def test_multi_select_is_three_valued(spark):
    df = spark.createDataFrame([(0, None, None), (1, None, None), (0, 0, "Partner"), (0, 0, None)], "a int, b int, t string")
    flag = R.multi_select(["a", "b"], "t", "Partner")
    assert [r[0] for r in df.select(flag).collect()] == [None, 1, 1, 0]


def test_residual_flags(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (None, 0)], "a int, b int").withColumn("none", R.none_of(["a", "b"]))
    got = df.withColumn("any", R.complement("none")).select("none", "any").collect()
    assert [tuple(r) for r in got] == [(1, 0), (0, 1), (None, None)]


def test_median_split_uses_non_zero_median(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (1.0,), (3.0,), (5.0,), (9.0,), (None,)], "x double")
    got = {r["x"]: r["c"] for r in R.median_split(df, "x", "c").collect()}
    # The median of 1, 3, 5, 9 is 4.
    assert got == {0.0: "Zero", 1.0: "Low", 3.0: "Low", 5.0: "High", 9.0: "High", None: "Don't know"}


def test_band_and_years(spark):
    df = spark.createDataFrame([(24,), (25,), (40,), (None,)], "age int")
    got = [r[0] for r in df.select(R.band("age", [25], ["18-24", "25-34"])).collect()]
    assert got == ["18-24", "25-34", "25-34", None]
    day = F.lit("2018-05-01").cast("date")
    df = spark.createDataFrame([(2010,), (2099,), (None,)], "y int")
    got = [r[0] for r in df.select(R.years_since_event(day, "y", 2099, F.lit(30))).collect()]
    assert got == [8, 30, None]


@pytest.mark.parametrize("value, expected", [(1, 6), (6, 1), (None, None)])
def test_reverse(spark, value, expected):
    df = spark.createDataFrame([(value,)], "x int")
    assert df.select(C.reverse_code("x", 1, 6)).first()[0] == expected
