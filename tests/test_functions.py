from __future__ import annotations

import datetime
import math

import pytest
from pyspark.sql import functions as F

from panelyst.functions import nulls as N
from panelyst.functions import scalars as S
from panelyst.functions import tails


def one(spark, *cols, **values):
    df = spark.range(1).select(*[v.alias(k) for k, v in values.items()])
    return df.select(*cols).first()


def test_null_condition_gives_null(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "x int")
    got = [r[0] for r in df.select(N.if_else(F.col("x") == 1, F.lit("y"), F.lit("n"))).collect()]
    assert got == ["y", "n", None]


def test_membership_and_regex_are_never_null(spark):
    r = one(spark, N.is_in("x", [1, 2]), N.matches("t", "a"), x=F.lit(None).cast("int"), t=F.lit(None).cast("string"))
    assert list(r) == [False, False]


def test_row_sums(spark):
    df = spark.createDataFrame([(1, 2), (1, None), (None, None)], "a int, b int")
    got = df.select(N.row_sum(["a", "b"]), N.row_sum(["a", "b"], False), N.null_count(["a", "b"])).collect()
    assert [tuple(r) for r in got] == [(3, 3, 0), (1, None, 1), (0, None, 2)]


def test_any_equal_is_null_with_a_missing_item(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, None)], "a int, b int")
    assert [r[0] for r in df.select(N.any_equal(["a", "b"])).collect()] == [True, False, None]


@pytest.mark.parametrize(
    "values, expected", [([1, 0], 1), ([1, None], 1), ([0, None], None), ([0, 0], 0), ([None], None)]
)
def test_agg_any(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "x int")
    assert df.agg(N.agg_any(F.col("x") == 1)).first()[0] == expected


def test_all_null_sum_is_zero(spark):
    df = spark.createDataFrame([(None,)], "x int")
    assert df.agg(N.agg_sum0("x")).first()[0] == 0


def test_dates(spark):
    r = one(
        spark,
        S.from_day_number("n"),
        S.parse_date("good"),
        S.parse_date("bad"),
        S.age_years(F.lit("2018-03-01").cast("date"), F.lit("2000-03-01").cast("date")),
        n=F.lit(21000),
        good=F.lit("2018-02-03"),
        bad=F.lit("03.02.2018"),
    )
    assert list(r) == [
        datetime.date(1960, 1, 1) + datetime.timedelta(days=21000),
        datetime.date(2018, 2, 3),
        None,
        math.floor((datetime.date(2018, 3, 1) - datetime.date(2000, 3, 1)).days / 365.25),
    ]


@pytest.mark.parametrize("days, inside", [(0, True), (183, True), (184, False), (-1, False)])
def test_window_edges(spark, days, inside):
    index = F.lit("2018-07-01").cast("date")
    assert one(spark, S.within_days("i", "v"), i=index, v=F.date_sub(index, days))[0] is inside


def test_padding_never_cuts(spark):
    df = spark.createDataFrame([("7",), ("12345",), (None,)], "id string")
    assert [r[0] for r in df.select(S.pad_left("id", 4)).collect()] == ["0007", "12345", None]


def test_indicators(spark):
    df = spark.createDataFrame([(1,), (9,), (0,), (98,), (None,)], "x int")
    got = df.select(S.positive("x"), S.positive_in_range("x")).collect()
    assert [tuple(r) for r in got] == [(1, 1), (0, 1), (0, 0), (0, 0), (None, None)]


def test_ratio_and_text(spark):
    r = one(
        spark,
        S.ratio(F.lit(1), F.lit(0)),
        S.ratio(F.lit(1), F.lit(3), 3),
        S.percent_text(F.lit(0.1234)),
        S.count_text(F.lit(3), F.lit(0.25), F.lit(12)),
        S.key_part(F.lit("CBW_0012"), 2),
        S.extract_text(F.lit("no digits"), r"(\d+)"),
        x=F.lit(1),
    )
    assert list(r) == [None, 0.333, "12.3%", "3/12 (25.0%)", "0012", None]


def test_tails_against_closed_forms():
    # Two degrees of freedom: exp(-x/2). One: erfc(sqrt(x/2)).
    for x in (0.01, 0.5, 3.0, 20.0, 150.0):
        assert tails.chi2_tail(x, 2) == pytest.approx(math.exp(-x / 2), rel=1e-12)
        assert tails.chi2_tail(x, 1) == pytest.approx(math.erfc(math.sqrt(x / 2)), rel=1e-11)
    # F with 2 and d degrees: (1 + 2f/d)^(-d/2).
    for f, d in ((0.1, 7), (3.0, 12.5), (9.0, 500.0)):
        assert tails.f_tail(f, 2, d) == pytest.approx((1 + 2 * f / d) ** (-d / 2), rel=1e-10)
    # An F with one numerator degree and very many others is a squared normal.
    assert tails.f_tail(3.8414588, 1, 1e7) == pytest.approx(0.05, abs=1e-6)
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-7)


def test_tail_columns_keep_null(spark):
    df = spark.createDataFrame([(5.99, 2), (None, 2)], "x double, df int")
    got = [r[0] for r in df.select(tails.chi2_p("x", "df")).collect()]
    assert got[0] == pytest.approx(math.exp(-5.99 / 2)) and got[1] is None
