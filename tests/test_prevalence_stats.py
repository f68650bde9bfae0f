from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyst.operators import groups as G
from panelyst.operators import prevalence as P
from panelyst.operators import stats as S
from panelyst.operators import tables as T

CATALOG = [
    P.Question("a", "Health", "Diet", "Lifetime"),
    P.Question("b", "Health", "Sport", "Lifetime"),
    P.Question("c", "Work", "Search", "Now"),
    P.Question("d", "Work", "Extra", "Now", in_any=False),
]
ANSWERS = [
    ("g", 1, 0, 0, 1),
    ("g", 0, None, 1, 0),
    ("g", 1, 1, 9, 0),
    ("h", None, None, None, None),
    ("h", 0, 0, 1, None),
]


@pytest.fixture
def answers(spark):
    return spark.createDataFrame(ANSWERS, "grp string, a int, b int, c int, d int")


def by_variable(df, *extra):
    return {tuple(r[c] for c in (*extra, "variable")): (r["n"], r["total"], r["proportion"]) for r in df.collect()}


def test_item_prevalence_denominators(answers):
    most = by_variable(P.item_prevalence(answers, CATALOG))
    assert most[("a",)] == (2, 4, 0.5) and most[("b",)] == (1, 4, 0.25) and most[("d",)] == (1, 4, 0.25)
    answered = by_variable(P.item_prevalence(answers, CATALOG, denominator="answered", any_rows=False))
    assert answered[("b",)] == (1, 3, 0.333) and answered[("d",)] == (1, 3, 0.333)
    rows = by_variable(P.item_prevalence(answers, CATALOG, denominator="rows", any_rows=False))
    assert rows[("a",)] == (2, 5, 0.4) and len(rows) == 4


def test_any_rows_count_people_once_over_all_rows(answers):
    got = by_variable(P.item_prevalence(answers, CATALOG))
    assert got[("Health / Lifetime",)] == (2, 5, 0.4)
    assert got[("Work / Now",)] == (2, 5, 0.4)  # the extra item does not count


def test_category_indicator_needs_all_items(answers):
    got = by_variable(P.category_prevalence(answers, CATALOG, ["grp"]), "grp")
    assert got[("g", "Health / Lifetime")] == (2, 2, 1.0)
    assert got[("h", "Health / Lifetime")] == (0, 1, 0.0)
    assert got[("g", "Work / Now")] == (1, 3, 0.333)


def test_empty_group_proportion_is_null(answers):
    got = by_variable(P.item_prevalence(answers.where("a IS NULL"), CATALOG))
    assert got[("a",)] == (0, 0, None)


def test_unknown_denominator(answers):
    with pytest.raises(ValueError):
        P.item_prevalence(answers, CATALOG, denominator="people")


def cells(spark, table, header="h"):
    rows = [(header, f"r{i}", f"c{j}", n) for i, line in enumerate(table) for j, n in enumerate(line)]
    return spark.createDataFrame(rows, "header string, row string, col string, n long")


def run_chi(df):
    return S.with_chi2_p(S.chi_square(df)).first()


def test_chi_square_textbook(spark):
    # Party by sex, Agresti (2007), p. 39: X-squared 30.07, df 2, p 2.954e-07.
    r = run_chi(cells(spark, [[762, 327, 468], [484, 239, 477]]))
    assert r["statistic"] == pytest.approx(30.070, abs=5e-4) and r["df"] == 2
    assert r["p"] == pytest.approx(2.954e-07, rel=1e-3) and r["low_expected"] == 0


def brute_chi(table, yates=False):
    o = np.array(table, float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    gap = np.abs(o - e)
    return ((gap - (min(0.5, gap.min()) if yates else 0)) ** 2 / e).sum(), e.min()


@pytest.mark.parametrize("table", [[[12, 5], [7, 7]], [[30, 10], [10, 30]], [[10, 10], [10, 10]], [[3, 0], [0, 4]]])
def test_two_by_two_gets_the_correction(spark, table):
    stat, smallest = brute_chi(table, yates=True)
    r = run_chi(cells(spark, table))
    assert r["statistic"] == pytest.approx(stat, abs=1e-10) and r["df"] == 1
    assert r["low_expected"] == int(smallest < 5)


def test_zero_cells_may_be_absent(spark):
    table = [[5, 0, 9], [0, 8, 2], [7, 3, 0]]
    full = cells(spark, table)
    stat, _ = brute_chi(table)
    for df in (full, full.where("n > 0")):
        r = run_chi(df)
        assert r["statistic"] == pytest.approx(stat) and r["df"] == 4 and r["low_expected"] == 1


def test_single_row_is_goodness_of_fit(spark):
    # Counts 20, 15, 25 against equal shares: 2.5 on 2 degrees, p 0.2865.
    r = run_chi(cells(spark, [[20, 15, 25]]))
    assert r["statistic"] == pytest.approx(2.5) and r["df"] == 2 and r["p"] == pytest.approx(math.exp(-1.25))


def test_zero_margin_is_null(spark):
    assert run_chi(cells(spark, [[5, 0, 9], [4, 0, 2]]))["statistic"] is None
    df = cells(spark, [[5, 9], [4, 2], [3, 3]])
    assert S.chi_square(df, ["c0", "c1", "c2"]).first()["statistic"] is None
    plain = S.chi_square(df).first()["statistic"]
    assert S.chi_square(df, ["c0", "c1"]).first()["statistic"] == pytest.approx(plain, rel=1e-12)


def test_headers_are_separate_tests(spark):
    both = cells(spark, [[20, 15, 25]], "one").union(cells(spark, [[762, 327, 468], [484, 239, 477]], "two"))
    got = {r["header"]: r["df"] for r in S.chi_square(both).collect()}
    assert got == {"one": 2, "two": 2}


def test_factor_chi_squares_equal_table_route(spark):
    df = spark.range(400).select(
        (F.col("id") % 3).cast("string").alias("g"), (F.col("id") * F.col("id") % 5).cast("string").alias("f")
    )
    via_table = S.table_chi_square(T.one_factor_tables(df, "g", {"f": "F"})).first()
    direct = S.factor_chi_squares(df, "g", {"f": "F"}).first()
    assert via_table["statistic"] == pytest.approx(direct["statistic"]) and via_table["df"] == direct["df"]


SLEEP = {
    "1": [0.7, -1.6, -0.2, -1.2, -0.1, 3.4, 3.7, 0.8, 0.0, 2.0],
    "2": [1.9, 0.8, 1.1, 0.1, -0.1, 4.4, 5.5, 1.6, 4.6, 3.4],
}


def test_welch_textbook(spark):
    # Student's sleep data: F 3.4626 on 1 and 17.776 degrees, p 0.07939.
    df = spark.createDataFrame([(g, v) for g, vs in SLEEP.items() for v in vs], "g string, extra double")
    r = S.with_f_p(S.welch_anova(df, "g", ["extra"])).first()
    assert r["f"] == pytest.approx(3.4626, abs=5e-5) and r["df1"] == 1
    assert r["df2"] == pytest.approx(17.776, abs=5e-4) and r["p"] == pytest.approx(0.07939, abs=5e-6)


def test_welch_needs_two_values_and_spread(spark):
    short = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0)], "g string, v double")
    flat = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 5.0)], "g string, v double")
    for df in (short, flat):
        assert S.welch_anova(df, "g", ["v"]).first()["f"] is None


def newton(x, y):
    x, y = np.array(x, float), np.array(y, float)
    X = np.column_stack([np.ones_like(x), x])
    b = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-X @ b))
        info = X.T @ (X * (p * (1 - p))[:, None])
        b = b + np.linalg.solve(info, X.T @ (y - p))
    return b, np.sqrt(np.diag(np.linalg.inv(info)))


def outcome_frame(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(18, 35, 300)
    y = (rng.random(300) < 1 / (1 + np.exp(3 - 0.12 * x))).astype(int)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)] + [(None, 1), (20, None)], "age int, Set int")
    return df, x, y


def test_logit_matches_newton(spark):
    df, x, y = outcome_frame(spark)
    b, se = newton(x, y)
    r = S.with_normal_p(S.logit_wald(df, "Set", ["age"])).first()
    assert r["intercept"] == pytest.approx(b[0], rel=1e-6) and r["slope"] == pytest.approx(b[1], rel=1e-6)
    assert r["z"] == pytest.approx(b[1] / se[1], rel=1e-5)
    assert r["p"] == pytest.approx(math.erfc(abs(b[1] / se[1]) / math.sqrt(2)), rel=1e-4)


def test_logit_reports_what_it_cannot_fit(spark):
    df, x, y = outcome_frame(spark)
    odd = df.withColumns({"flat": F.lit(1.5), "none": F.lit(None).cast("int"), "parted": F.col("Set") * 10})
    got = {r["variable"]: r for r in S.logit_wald(odd, "Set", ["flat", "age", "none", "parted"]).collect()}
    assert list(got) == ["flat", "age", "none", "parted"]
    assert [r["converged"] for r in got.values()] == [0, 1, 0, 0]
    assert all(got[v][c] is None for v in ("flat", "none", "parted") for c in ("intercept", "slope", "std_error", "z"))
    one_sided = S.logit_wald(df.where("Set = 1"), "Set", ["age"]).first()
    assert one_sided["converged"] == 0 and one_sided["slope"] is None


def test_chi_square_of_large_counts_has_no_cross_join(spark):
    big = 10**11
    table = [[big, big + 40_000, big], [big + 30_000, big, big], [0, 7, 9]]
    cells = [("h", f"r{i}", f"c{j}", n) for i, row in enumerate(table) for j, n in enumerate(row) if n]
    t = S.chi_square(spark.createDataFrame(cells, "header string, row string, col string, n long"))
    from fractions import Fraction

    rows, cols = [sum(r) for r in table], [sum(c) for c in zip(*table)]
    total = sum(rows)
    exact = sum(
        (Fraction(n) - Fraction(rows[i] * cols[j], total)) ** 2 / Fraction(rows[i] * cols[j], total)
        for i, row in enumerate(table)
        for j, n in enumerate(row)
    )
    assert t.first()["statistic"] == pytest.approx(float(exact), rel=1e-6)
    one = S.chi_square(S.contingency(spark.range(50).selectExpr("id % 2 as a", "id % 3 as b"), "a", "b"))
    one.collect()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_binned_residuals_match_brute_force(spark):
    df, x, y = outcome_frame(spark)
    b, _ = newton(x, y)
    eta = b[0] + b[1] * x
    p = 1 / (1 + np.exp(-eta))
    res = np.where(y == 1, np.sqrt(-2 * np.log(p)), -np.sqrt(-2 * np.log(1 - p)))
    k = int(math.sqrt(len(x)))
    last = np.array([(eta <= e).sum() for e in eta])
    bins = np.ceil(last * k / len(x)).astype(int)
    got = {r["bin"]: r for r in S.binned_residuals(df, "Set", "age", b[0], b[1], bins=k).collect()}
    assert set(got) == set(bins)
    for bin_ in set(bins):
        inside = bins == bin_
        r = got[bin_]
        assert r["n"] == inside.sum() and r["mean_x"] == pytest.approx(eta[inside].mean())
        assert r["mean_residual"] == pytest.approx(res[inside].mean())
        assert r["band"] == pytest.approx(2 * res[inside].std(ddof=1) / math.sqrt(inside.sum()))


def test_attrition_merges_and_notes(spark):
    df = spark.range(200).select(
        (F.col("id") % 3 == 0).cast("int").alias("Set"),
        F.element_at(F.array(*[F.lit(x) for x in ("p", "q", "r", None)]), (F.col("id") % 4 + 1).cast("int")).alias("race"),
    )
    t = S.attrition_chi_square(df, ["race"], merge={"race": {"q": "p"}}).first()
    table = [[df.where(f"Set = {s} AND race IN ({lv})").count() for lv in ("'p','q'", "'r'")] for s in (0, 1)]
    assert t["statistic"] == pytest.approx(brute_chi(table, yates=True)[0]) and t["note"] == "'q' merged into 'p'"


def test_group_helpers(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 3), (None, 4), ("b", None)], "g string, n int")
    shares = {(r["g"], r["n"]): r["share"] for r in G.share_of_group(df, "n", ["g"]).collect()}
    assert shares == {("a", 1): 0.25, ("a", 3): 0.75, (None, 4): 1.0, ("b", None): None}
    both = {(r["g"], r["is_overall"]): r["s"] for r in G.overall_and_by_group(df, "g", s=F.sum("n")).collect()}
    assert both == {("a", 0): 4, (None, 0): 4, ("b", 0): None, (None, 1): 8}
    tab = G.crosstab(df, "g", "n", ["a", "c"], ["1", "2"])
    assert {tuple(r) for r in tab.collect()} == {("a", "1", 1), ("a", "2", 0), ("c", "1", 0), ("c", "2", 0)}
