"""Tests across groups. The data collapse to counts or moments first; the
statistics are then a handful of small aggregates on those."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from panelyst.functions.tails import chi2_p, f_p, normal_p
from panelyst.operators.clean import SPECIAL_LEVELS
from panelyst.operators.quantiles import running_total
from panelyst.operators.tables import group_moments, level_counts
from panelyst.sources.sinks import materialise

# Fixed value: an expected count below this draws a warning.
LOW_EXPECTED = 5


def contingency(df: DataFrame, row: str, col: str, header: str | None = None) -> DataFrame:
    """Non-zero cells ``(header, row, col, n)``; rows with either side NULL are left out."""
    return (
        df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
        .groupBy(F.col(row).cast("string").alias("row"), F.col(col).cast("string").alias("col"))
        # an aggregate, since a literal would be folded out of the joins on it
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.lit(header or row)).alias("header"))
        .select("header", "row", "col", "n")
    )


def chi_square(cells: DataFrame, col_levels: Sequence[str] | None = None) -> DataFrame:
    """Chi-square test per header from cells ``(header, row, col, n)``.

    Absent cells count as 0, so sparse counts will do. Their part of the sum is their expected counts, which is
    N^2 less all R*C of the present cells, over N, taken in whole numbers so that nothing cancels.
    A 2x2 table gets the continuity correction (all four |O-E| are equal there).
    A single row or column is tested against equal shares. A zero margin gives
    NULL; ``col_levels`` lists columns that count as empty where no cell has them.
    ``low_expected`` marks tests with an expected count under 5.
    """
    rows = cells.groupBy("header", "row").agg(F.sum("n").alias("r"))
    of_col = cells.select("header", "col", "n")
    if col_levels is not None:
        levels = F.array(*[F.lit(x) for x in col_levels])
        of_col = of_col.union(
            rows.select("header").distinct().select("header", F.explode(levels), F.lit(0).cast("long"))
        )
    cols = of_col.groupBy("header", "col").agg(F.sum("n").alias("c"))

    def margins(side: DataFrame, n: str, name: str) -> DataFrame:
        return side.groupBy("header").agg(
            F.count(F.lit(1)).alias(f"n{name}"),
            F.sum(n).alias(f"total_{name}"),
            F.min(n).alias(f"min_{name}"),
            F.sum(F.try_divide(F.lit(1.0), F.col(n))).alias(f"inv_{name}"),
        )

    # one aggregate brings both kinds of margin together
    both = margins(rows, "r", "r").unionByName(margins(cols, "c", "c"), allowMissingColumns=True)
    named = ["nr", "nc", "total_r", "min_r", "min_c", "inv_r", "inv_c"]
    margin = both.groupBy("header").agg(*[F.max(x).alias(x) for x in named])
    n, r, c = (F.col(x).cast("double") for x in ("n", "r", "c"))
    total = F.col("total_r").cast("double")
    single = (F.col("nr") == 1) | (F.col("nc") == 1)
    k = F.col("nr") * F.col("nc")
    expected = F.when(single, total / k).otherwise(F.try_divide(r * c, total))
    product = F.col("r").cast("decimal(19,0)") * F.col("c").cast("decimal(19,0)")
    t = (
        cells.join(rows, ["header", "row"])
        .join(cols, ["header", "col"])
        .join(margin, "header")
        .groupBy("header")
        .agg(
            *[F.max(x).alias(x) for x in named],
            F.sum(F.try_divide(F.pow(n - expected, 2), expected)).alias("s"),
            F.count(F.lit(1)).alias("present"),
            F.sum(product).alias("products"),
            F.max(F.abs(n - expected)).alias("gap"),
        )
    )
    two_by_two = (F.col("nr") == 2) & (F.col("nc") == 2)
    square = F.col("total_r").cast("decimal(19,0)") * F.col("total_r").cast("decimal(19,0)")
    absent = F.when(single, (k - F.col("present")) * total / k).otherwise(
        F.try_divide((square - F.col("products")).cast("double"), total)
    )
    yates = F.pow(F.col("gap") - F.least(F.lit(0.5), F.col("gap")), 2) * total * F.col("inv_r") * F.col("inv_c")
    zero_margin = (F.col("min_r") == 0) | (F.col("min_c") == 0)
    stat = (
        F.when(k == 1, F.lit(None))
        .when(single, F.col("s") + absent)
        .when(zero_margin, F.lit(None))
        .when(two_by_two, yates)
        .otherwise(F.col("s") + absent)
    )
    smallest = F.when(single, total / k).otherwise(
        F.try_divide(F.col("min_r") * F.col("min_c").cast("double"), total)
    )
    return t.select(
        "header",
        stat.alias("statistic"),
        F.when(single, k - 1).otherwise((F.col("nr") - 1) * (F.col("nc") - 1)).cast("long").alias("df"),
        F.coalesce(smallest < LOW_EXPECTED, F.lit(False)).cast("int").alias("low_expected"),
    )


def with_chi2_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p", chi2_p("statistic", "df"))


def table_chi_square(table: DataFrame) -> DataFrame:
    """Chi-square per header of a frequency table, levels against groups."""
    cells = table.where("is_overall = 0").select(
        "header", F.col("level").alias("row"), F.col("grp").alias("col"), "n"
    )
    return chi_square(cells)


def factor_chi_squares(
    df: DataFrame,
    group: str,
    factors: Mapping[str, str],
    groups: Sequence[str] | None = None,
    exclude: Sequence[str] = SPECIAL_LEVELS,
) -> DataFrame:
    """Chi-square of many factors against the group, straight from one scan's counts."""
    counts = level_counts(df, group, factors, exclude).where(F.col("grp").isNotNull())
    cells = counts.select("header", F.col("level").alias("row"), F.col("grp").alias("col"), "n")
    return chi_square(cells, groups)


def attrition_chi_square(
    df: DataFrame, variables: Sequence[str], flag: str = "Set", merge: dict[str, dict[str, str]] | None = None
) -> DataFrame:
    """Chi-square of retention against each variable, all from one scan.

    ``merge`` joins levels of a variable before the test; its use is noted.
    """
    merge = merge or {}

    def level(v: str):
        c = F.col(v).cast("string")
        for old, new in merge.get(v, {}).items():
            c = F.when(c == old, new).otherwise(c)
        return c

    note = F.lit("")
    for v, pairs in merge.items():
        text = "; ".join(f"'{old}' merged into '{new}'" for old, new in pairs.items())
        note = F.when(F.col("header") == v, text).otherwise(note)
    boxes = F.array(
        *[F.struct(F.lit(v).alias("header"), level(v).alias("col")) for v in variables]
    )
    cells = (
        df.where(F.col(flag).isNotNull())
        .select(F.col(flag).cast("string").alias("row"), F.inline(boxes))
        .where(F.col("col").isNotNull())
        .groupBy("header", "row", "col")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return chi_square(cells).withColumn("note", note)


def welch_anova(df: DataFrame, group: str, variables: Sequence[str]) -> DataFrame:
    """One-way analysis of means without assuming equal variances.

    All variables share one scan. NULL when a group has under two values or no
    spread, or when there is only one group.
    """
    m = group_moments(df.where(F.col(group).isNotNull()), group, variables).where("n > 0")
    var = F.try_divide(F.col("m2"), F.col("n") - 1)
    m = m.withColumn("w", F.try_divide(F.col("n"), var))
    w = F.col("w")
    sums = m.groupBy("variable").agg(
        F.count(F.lit(1)).alias("k"),
        F.count("w").alias("usable"),
        F.sum("w").alias("sum_w"),
        F.try_divide(F.sum(w * F.col("mean")), F.sum("w")).alias("centre"),
    )
    t = (
        m.join(sums, "variable")
        .groupBy("variable")
        .agg(
            F.max("k").alias("k"),
            F.max("usable").alias("usable"),
            F.sum(w * F.pow(F.col("mean") - F.col("centre"), 2)).alias("between"),
            F.sum(F.try_divide(F.pow(1 - F.try_divide(w, F.col("sum_w")), 2), F.col("n") - 1)).alias("l"),
        )
    )
    k = F.col("k").cast("double")
    lam = F.try_divide(F.col("l"), k * k - 1)
    ok = (F.col("usable") == F.col("k")) & (F.col("k") > 1)
    return t.select(
        "variable",
        F.when(ok, F.try_divide(F.col("between"), (k - 1) * (1 + 2 * (k - 2) * lam))).alias("f"),
        F.when(ok, k - 1).alias("df1"),
        F.when(ok, F.try_divide(F.lit(1.0), 3 * lam)).alias("df2"),
    )


def with_f_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p", f_p("f", "df1", "df2"))


_LOGIT = StructType(
    [
        StructField("variable", StringType()),
        StructField("intercept", DoubleType()),
        StructField("slope", DoubleType()),
        StructField("std_error", DoubleType()),
        StructField("z", DoubleType()),
        StructField("converged", IntegerType()),
    ]
)
#: Newton steps at most, and the change of both coefficients, on a standardised predictor, that ends them.
NEWTON_STEPS, NEWTON_CHANGE = 30, 1e-9
#: Bins that the values of a predictor are put in before a fit.
BINS = 4096


def grouped_outcomes(df: DataFrame, outcome: str, x: str) -> DataFrame:
    """``(x, n, s)``: rows and successes per distinct predictor value.

    Holds all a one-predictor logit needs, so the fit iterates over this and
    not over the data.
    """
    return (
        df.where(F.col(outcome).isNotNull() & F.col(x).isNotNull())
        .groupBy(F.col(x).cast("double").alias("x"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(outcome).cast("long")).alias("s"))
    )


def outcomes_by_value(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    """``(variable, x, n, s)``: rows and successes per distinct value of each predictor, from one scan."""
    values = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x")) for v in predictors])
    return (
        df.where(F.col(outcome).isNotNull())
        .select(F.col(outcome).cast("long").alias("y"), F.inline(values))
        .where(F.col("x").isNotNull())
        .groupBy("variable", "x")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    )


def _value_bins(pairs: DataFrame) -> DataFrame:
    """Rows, successes and mean value of each bin of equal width of each predictor, with the range of its values."""
    shape = pairs.groupBy("variable").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    width = (F.col("high") - F.col("low")) / BINS
    place = F.least(F.floor(F.try_divide(F.col("x") - F.col("low"), width)), F.lit(BINS - 1))
    n = F.col("n").cast("double")
    binned = pairs.join(shape, "variable").groupBy("variable", F.coalesce(place, F.lit(0)).alias("bin"))
    return binned.agg(
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        (F.sum(F.col("x") * n) / F.sum(n)).alias("x"),
        F.count(F.lit(1)).alias("values"),
        F.max("low").alias("low"),
        F.max("high").alias("high"),
    )


def _step(i0: float, i1: float, i2: float, u0: float, u1: float) -> tuple[float, float] | None:
    """The Newton step of sums of information and score; None where they do not fix both coefficients."""
    det = i0 * i2 - i1 * i1
    return ((i2 * u0 - i1 * u1) / det, (i0 * u1 - i1 * u0) / det) if det > 1e-12 * i0 * i2 else None


def _fit_bins(bins: list, mean: float, half: float) -> tuple[float, float] | None:
    """Coefficients of the logit on the bins of one predictor, standardised; None if there are none."""
    import numpy as np

    n, s, x = (np.array([b[c] for b in bins], float) for c in ("n", "s", "x"))
    z = (x - mean) / half
    a = b = 0.0
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-np.clip(a + b * z, -700, 700)))
        w, off = n * p * (1 - p), s - n * p
        step = _step(*(float(e.sum()) for e in (w, w * z, w * z * z, off, off * z)))
        if step is None:
            return None
        a, b = a + step[0], b + step[1]
        if max(map(abs, step)) < NEWTON_CHANGE:
            break
    return a, b


def logit_wald(df: DataFrame, outcome: str, predictors: Sequence[str]) -> DataFrame:
    """One-predictor logistic regressions with Wald z: one row per predictor, in the order given.

    The counts of (predictor, value) are staged once and put into bins. Newton steps on the bins, at most ``BINS``
    a predictor, are taken where they are; a pass over all values, all predictors together, then makes the fit exact,
    since a Newton step squares what is left of the error. It is repeated until the step is small enough for that.
    ``converged`` is 0 where there is no estimate, and the statistics are NULL there: a predictor that is constant,
    always missing or parts the outcomes perfectly, or an outcome that is always the same.
    """
    pairs = materialise(outcomes_by_value(df, outcome, predictors), "outcomes")
    bins: dict[str, list] = {}
    for r in _value_bins(pairs).collect():  # up to BINS rows per predictor
        bins.setdefault(r["variable"], []).append(r)
    scale: dict[str, tuple[float, float]] = {}
    beta: dict[str, tuple[float, float]] = {}
    for v, found in bins.items():
        n, s = sum(r["n"] for r in found), sum(r["s"] for r in found)
        low, high = found[0]["low"], found[0]["high"]
        if high > low and 0 < s < n:
            scale[v] = (sum(r["x"] * r["n"] for r in found) / n, (high - low) / 2)
            start = _fit_bins(found, *scale[v])
            # bins that part the outcomes do so only if the values do
            if start is not None:
                beta[v] = start
    spread: dict[str, float] = {}
    moving = set(beta)
    n = F.col("n").cast("double")
    for _ in range(NEWTON_STEPS):
        if not moving:
            break
        known = F.create_map(*[F.lit(x) for v in sorted(moving) for x in (v, list((*scale[v], *beta[v])))])
        at = pairs.where(F.col("variable").isin(sorted(moving))).withColumn("b", known[F.col("variable")])
        z = (F.col("x") - F.col("b")[0]) / F.col("b")[1]
        p = 1 / (1 + F.exp(-(F.col("b")[2] + F.col("b")[3] * F.col("z"))))
        w = n * F.col("p") * (1 - F.col("p"))
        off = F.col("s") - n * F.col("p")
        sums = (
            at.withColumn("z", z)
            .withColumn("p", p)
            .groupBy("variable")
            .agg(*[F.sum(e) for e in (w, w * F.col("z"), w * F.col("z") * F.col("z"), off, off * F.col("z"))])
        )
        for v, *found in sums.collect():  # one row per predictor
            step = _step(*found)
            if step is None:
                moving.discard(v)
                del beta[v]
                continue
            beta[v] = (beta[v][0] + step[0], beta[v][1] + step[1])
            # the next step would be about the square of this one
            if max(map(abs, step)) < NEWTON_CHANGE**0.5:
                i0, i1, i2 = found[:3]
                spread[v] = (i0 / (i0 * i2 - i1 * i1)) ** 0.5 / scale[v][1]
                moving.discard(v)
    out = []
    for v in predictors:
        if v not in spread:
            out.append((v, None, None, None, None, 0))
            continue
        slope = beta[v][1] / scale[v][1]
        out.append((v, beta[v][0] - slope * scale[v][0], slope, spread[v], slope / spread[v], 1))
    return df.sparkSession.createDataFrame(out, _LOGIT)


def with_normal_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p", normal_p("z"))


def binned_residuals(
    df: DataFrame, outcome: str, x: str, intercept: float, slope: float, bins: int | Column
) -> DataFrame:
    """Mean predictor and deviance residual by bins of the linear predictor.

    Bins hold equal numbers of rows by cumulative share; tied rows stay together.
    ``bins`` is their number, or an expression of ``total``, the number of rows.
    ``band`` is 2 sd / sqrt(n).
    """
    eta = F.lit(float(intercept)) + F.lit(float(slope)) * F.col("x")
    g = (
        grouped_outcomes(df, outcome, x)
        .withColumn("eta", eta)
        .groupBy("eta")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    )
    ranked = running_total(g, "eta", "n")
    n_all = F.col("total")
    k = F.lit(bins) if isinstance(bins, int) else bins
    prob_term = F.log1p(F.exp(-F.abs(F.col("eta")))) + F.greatest(F.col("eta"), F.lit(0.0))
    # Deviance residuals of the two outcomes: -2 log(1-p) = 2 log(1+e^eta), and
    # -2 log(p) = that - 2 eta.
    r0 = -F.sqrt(2 * prob_term)
    r1 = F.sqrt(F.greatest(2 * prob_term - 2 * F.col("eta"), F.lit(0.0)))
    binned = ranked.select(
        (F.ceil(F.col("cum") * k / n_all)).cast("long").alias("bin"), "eta", "n", "s", r0.alias("r0"), r1.alias("r1")
    )
    fails = F.col("n") - F.col("s")
    sums = binned.groupBy("bin").agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("eta") * F.col("n")) / F.sum("n")).alias("mean_x"),
        (F.sum(F.col("r1") * F.col("s") + F.col("r0") * fails) / F.sum("n")).alias("mean_residual"),
        F.sum(F.col("r1") * F.col("r1") * F.col("s") + F.col("r0") * F.col("r0") * fails).alias("_sq"),
    )
    nn = F.col("n")
    var = F.greatest(
        F.try_divide(F.col("_sq") - nn * F.pow("mean_residual", F.lit(2)), nn - 1), F.lit(0.0)
    )
    return sums.select(
        "bin",
        "n",
        "mean_x",
        "mean_residual",
        F.when(nn > 1, 2 * F.sqrt(var) / F.sqrt(nn)).otherwise(F.lit(0.0)).alias("band"),
    )
