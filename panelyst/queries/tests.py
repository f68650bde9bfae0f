"""Hypothesis tests across groups and attrition comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyst.operators import stats as S
from panelyst.operators.link import link_waves
from panelyst.operators.tables import one_factor_tables
from panelyst.queries.base import PARTICIPANTS, participants, round_cols, table


def chi2_p_sql(x: str, df: str) -> str:
    """Upper chi-square tail by the series of the lower incomplete gamma."""
    return (
        f"CASE WHEN {x} <= 0 THEN 1.0 ELSE 1 - list_sum([exp(-({x}) / 2 + ({df} / 2.0 + i) * ln(({x}) / 2) "
        f"- lgamma({df} / 2.0 + i + 1)) for i in range(0, 600)]) END"
    )


def f_p_sql(f: str, d1: str, d2: str) -> str:
    """Upper F tail as 1 - I_y(d1/2, d2/2), y = d1 f / (d2 + d1 f), by its series."""
    y = f"({d1} * {f} / ({d2} + {d1} * {f}))"
    a, b = f"({d1} / 2.0)", f"({d2} / 2.0)"
    front = f"{a} * ln({y}) + {b} * ln(1 - {y}) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b})"
    term = f"lgamma({a} + {b} + i) - lgamma({a} + {b}) - lgamma({a} + 1 + i) + lgamma({a} + 1) + i * ln({y})"
    return f"1 - list_sum([exp({front} + {term}) for i in range(0, 1000)])"


def chi_square_sql(cells: str) -> str:
    """SQL twin of the chi-square test on a full grid (header, row, col, n)."""
    return f"""
WITH c AS ({cells}),
g AS (SELECT *, sum(n) OVER (PARTITION BY header, row) AS r, sum(n) OVER (PARTITION BY header, col) AS k,
        sum(n) OVER (PARTITION BY header) AS t FROM c),
d AS (SELECT header, count(DISTINCT row) AS nr, count(DISTINCT col) AS nc, count(*) AS cells FROM c GROUP BY header),
e AS (SELECT g.*, nr, nc, cells, CASE WHEN nr = 1 OR nc = 1 THEN t::DOUBLE / cells
        ELSE r::DOUBLE * k / t END AS e FROM g JOIN d USING (header)),
y AS (SELECT *, CASE WHEN nr = 2 AND nc = 2 THEN least(0.5, min(abs(n - e)) OVER (PARTITION BY header)) ELSE 0 END AS y
      FROM e)
SELECT header, CASE WHEN min(e) > 0 THEN round(sum((abs(n - e) - y) * (abs(n - e) - y) / e), 6) END AS statistic,
  CAST(CASE WHEN min(nr) = 1 OR min(nc) = 1 THEN min(cells) - 1 ELSE (min(nr) - 1) * (min(nc) - 1) END AS BIGINT) AS df,
  CAST(min(e) < 5 AS INTEGER) AS low_expected
FROM y GROUP BY header"""


def _grid_sql(base: str, header: str) -> str:
    """Full contingency grid of (row, col) pairs, NULLs left out."""
    return f"""SELECT '{header}' AS header, r.row, c.col, count(b.row) AS n
  FROM (SELECT DISTINCT row FROM ({base}) WHERE row IS NOT NULL AND col IS NOT NULL) r
  CROSS JOIN (SELECT DISTINCT col FROM ({base}) WHERE row IS NOT NULL AND col IS NOT NULL) c
  LEFT JOIN ({base}) b ON b.row = r.row AND b.col = c.col GROUP BY r.row, c.col"""


def chi_square(spark, sf):
    cells = S.contingency(participants(spark, sf), "c_mktsegment", "r_name", "Segment")
    return round_cols(S.with_chi2_p(S.chi_square(cells)), 6, "statistic", "p")


def _with_p(sql: str) -> str:
    return f"SELECT *, round({chi2_p_sql('statistic', 'df')}, 6) AS p FROM ({sql})"


def chi_square_low_counts(spark, sf):
    s = table(spark, sf, "supplier").withColumn("rich", F.when(F.col("s_acctbal") > 5000, "yes").otherwise("no"))
    return round_cols(S.with_chi2_p(S.chi_square(S.contingency(s, "rich", "s_nationkey", "Rich"))), 6, "statistic", "p")


def chi_square_yates(spark, sf):
    o = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("state"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").otherwise("other").alias("haste"),
    )
    return round_cols(S.with_chi2_p(S.chi_square(S.contingency(o, "state", "haste", "State"))), 6, "statistic", "p")


def chi_square_goodness_of_fit(spark, sf):
    o = table(spark, sf, "orders").withColumn("all", F.lit("everyone"))
    return round_cols(S.with_chi2_p(S.chi_square(S.contingency(o, "all", "o_orderpriority", "Priority"))), 6, "statistic", "p")


def chi_square_of_table(spark, sf):
    p = participants(spark, sf).withColumn("balance", F.floor(F.col("c_acctbal") / 4000).cast("string"))
    t = one_factor_tables(p, "r_name", {"c_mktsegment": "Segment", "balance": "Balance"})
    return round_cols(S.with_chi2_p(S.table_chi_square(t)), 6, "statistic", "p")


_ATTRITION_VARS = ["c_mktsegment", "r_name", "balance"]


def _linked(spark, sf):
    base = participants(spark, sf).withColumn("balance", F.floor(F.col("c_acctbal") / 4000).cast("string"))
    late = (
        table(spark, sf, "orders")
        .where(F.year("o_orderdate") == 2001)
        .select(F.col("o_custkey").alias("c_custkey"))
        .distinct()
    )
    return link_waves(base, late, ["c_custkey"], validate=False)


_LINKED = f"""SELECT p.*, CAST(floor(c_acctbal / 4000) AS INTEGER)::VARCHAR AS balance,
  CASE WHEN f.o_custkey IS NULL THEN 0 ELSE 1 END AS "Set" FROM ({PARTICIPANTS}) p
  LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 2001) f ON c_custkey = o_custkey"""


def attrition_chi_square(spark, sf):
    t = S.attrition_chi_square(
        _linked(spark, sf), _ATTRITION_VARS, merge={"c_mktsegment": {"FURNITURE": "HOUSEHOLD"}}
    )
    return round_cols(S.with_chi2_p(t), 6, "statistic", "p")


_ATTRITION = f"""SELECT *, CASE WHEN header = 'c_mktsegment' THEN '''FURNITURE'' merged into ''HOUSEHOLD''' ELSE '' END AS note
FROM ({_with_p(chi_square_sql(" UNION ALL ".join(
    f'SELECT * FROM ({_grid_sql(f"SELECT {q}Set{q}::VARCHAR AS row, {e} AS col FROM ({_LINKED})", h)})'
    for q, (h, e) in (('"', x) for x in (
        ("c_mktsegment", "CASE WHEN c_mktsegment = 'FURNITURE' THEN 'HOUSEHOLD' ELSE c_mktsegment END"),
        ("r_name", "r_name"),
        ("balance", "balance"),
    ))
)))})"""


def _prices(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).withColumns(
        {"log_price": F.log1p("o_totalprice"), "balance": F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))}
    )


def welch_anova(spark, sf):
    t = S.welch_anova(_prices(spark, sf), "c_mktsegment", ["o_totalprice", "log_price", "balance"])
    return round_cols(S.with_f_p(t), 5, "f", "df1", "df2", "p")



_WELCH = f"""
WITH d AS (SELECT c_mktsegment AS g, o_totalprice, ln(1 + o_totalprice) AS log_price,
    CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM orders JOIN customer ON o_custkey = c_custkey),
l AS (SELECT 'o_totalprice' AS variable, g, o_totalprice AS v FROM d UNION ALL
      SELECT 'log_price', g, log_price FROM d UNION ALL SELECT 'balance', g, balance FROM d),
m AS (SELECT variable, g, count(v) AS n, avg(v) AS m, count(v) / var_samp(v) AS w FROM l GROUP BY variable, g),
s AS (SELECT *, sum(w) OVER p AS tw, sum(w * m) OVER p / sum(w) OVER p AS c, count(*) OVER p AS k
      FROM m WINDOW p AS (PARTITION BY variable)),
a AS (SELECT variable, max(k) AS k, sum(w * (m - c) * (m - c)) AS b,
      sum((1 - w / tw) * (1 - w / tw) / (n - 1)) / (max(k) * max(k) - 1) AS lam FROM s GROUP BY variable),
t AS (SELECT variable, b / ((k - 1) * (1 + 2 * (k - 2) * lam)) AS f, CAST(k - 1 AS DOUBLE) AS df1, 1 / (3 * lam) AS df2
      FROM a)
SELECT variable, round(f, 5) AS f, df1, round(df2, 5) AS df2, round({f_p_sql("f", "df1", "df2")}, 5) AS p FROM t"""


def logit_wald(spark, sf):
    """Two fitted predictors, one that is constant and one that parts the outcomes."""
    df = _linked(spark, sf).withColumns({"nation": F.col("c_nationkey"), "constant": F.lit(3), "parted": F.col("Set") * 2 + 1})
    t = S.with_normal_p(S.logit_wald(df, "Set", ["nation", "c_acctbal", "constant", "parted"]))
    return t.select(
        "variable",
        F.round("intercept", 4).alias("intercept"),
        F.round("slope", 7).alias("slope"),
        F.round("std_error", 9).alias("std_error"),
        F.round("z", 4).alias("z"),
        F.round("p", 4).alias("p"),
        "converged",
    )


def _newton(x: str, rows: str, steps: int = 9) -> str:
    """Newton steps of a one-predictor logit on rows grouped by x."""
    ctes = [
        f"""g AS (SELECT CAST({x} AS DOUBLE) AS x, count(*) AS n, sum("Set") AS s FROM ({rows}) WHERE {x} IS NOT NULL GROUP BY 1)""",
        "k0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS i0, 0.0::DOUBLE AS i1, 0.0::DOUBLE AS i2)",
    ]
    for k in range(1, steps + 1):
        ctes.append(
            f"""k{k} AS MATERIALIZED (SELECT a + (i2 * u0 - i1 * u1) / (i0 * i2 - i1 * i1) AS a,
  b + (i0 * u1 - i1 * u0) / (i0 * i2 - i1 * i1) AS b, i0, i1, i2 FROM (
  SELECT max(a) AS a, max(b) AS b, sum(n * p * (1 - p)) AS i0, sum(n * p * (1 - p) * x) AS i1,
    sum(n * p * (1 - p) * x * x) AS i2, sum(s - n * p) AS u0, sum((s - n * p) * x) AS u1
  FROM (SELECT g.x, g.n, g.s, a, b, 1 / (1 + exp(-(a + b * x))) AS p FROM g CROSS JOIN k{k - 1})))"""
        )
    return ",\n".join(ctes)


def logit_sql(x: str, name: str, rows: str = _LINKED, digits: tuple[int, int, int] = (4, 7, 9)) -> str:
    error = "sqrt(i0 / (i0 * i2 - i1 * i1))"
    z = f"(b / {error})"
    return f"""SELECT * FROM (WITH {_newton(x, rows)}
SELECT '{name}' AS variable, round(a, {digits[0]}) AS intercept, round(b, {digits[1]}) AS slope,
  round({error}, {digits[2]}) AS std_error, round({z}, 4) AS z,
  1 AS converged, round({chi2_p_sql(f"{z} * {z}", "1")}, 4) AS p FROM k9)"""


def residuals_sql(x: str, rows: str = _LINKED, before: str = "") -> str:
    return f"""
WITH {before + "," if before else ""} {_newton(x, rows)},
r AS (SELECT a + b * {x} AS eta, "Set" AS y FROM ({rows}) CROSS JOIN k9 WHERE {x} IS NOT NULL),
c AS (SELECT eta, CASE WHEN y = 1 THEN sqrt(2 * ln(1 + exp(-eta))) ELSE -sqrt(2 * ln(1 + exp(eta))) END AS res,
  count(*) OVER (ORDER BY eta RANGE UNBOUNDED PRECEDING) AS last, count(*) OVER () AS t FROM r)
SELECT CAST(ceil(last * floor(sqrt(t)) / t) AS BIGINT) AS bin, count(*) AS n, round(avg(eta), 4) AS mean_x,
  round(avg(res), 4) AS mean_residual, round(2 * stddev_samp(res) / sqrt(count(*)), 4) AS band FROM c GROUP BY 1"""


def binned_residuals(spark, sf):
    df = _linked(spark, sf)
    fit = S.logit_wald(df, "Set", ["c_acctbal"]).first()
    t = S.binned_residuals(df, "Set", "c_acctbal", fit["intercept"], fit["slope"], bins=F.floor(F.sqrt("total")))
    return round_cols(t, 4, "mean_x", "mean_residual", "band")


QUERIES = {
    "chi_square": (
        chi_square,
        _with_p(
            chi_square_sql(_grid_sql(f"SELECT c_mktsegment AS row, r_name AS col FROM ({PARTICIPANTS})", "Segment"))
        ),
    ),
    "chi_square_low_counts": (
        chi_square_low_counts,
        _with_p(
            chi_square_sql(
                _grid_sql(
                    "SELECT CASE WHEN s_acctbal > 5000 THEN 'yes' ELSE 'no' END AS row, s_nationkey::VARCHAR AS col "
                    "FROM supplier",
                    "Rich",
                )
            )
        ),
    ),
    "chi_square_yates": (
        chi_square_yates,
        _with_p(
            chi_square_sql(
                _grid_sql(
                    "SELECT CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS row, "
                    "CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'other' END AS col FROM orders",
                    "State",
                )
            )
        ),
    ),
    "chi_square_goodness_of_fit": (
        chi_square_goodness_of_fit,
        _with_p(
            chi_square_sql(_grid_sql("SELECT 'everyone' AS row, o_orderpriority AS col FROM orders", "Priority"))
        ),
    ),
    "chi_square_of_table": (
        chi_square_of_table,
        _with_p(
            chi_square_sql(
                "SELECT * FROM ("
                + _grid_sql(f"SELECT c_mktsegment AS row, r_name AS col FROM ({PARTICIPANTS})", "Segment")
                + ") UNION ALL SELECT * FROM ("
                + _grid_sql(f"SELECT balance AS row, r_name AS col FROM ({_LINKED})", "Balance")
                + ")"
            )
        ),
    ),
    "attrition_chi_square": (attrition_chi_square, _ATTRITION),
    "welch_anova": (welch_anova, _WELCH),
    "logit_wald": (
        logit_wald,
        logit_sql("c_nationkey", "nation") + " UNION ALL " + logit_sql("c_acctbal", "c_acctbal")
        + " UNION ALL SELECT v, NULL, NULL, NULL, NULL, 0, NULL FROM (VALUES ('constant'), ('parted')) t(v)",
    ),
    "binned_residuals": (binned_residuals, residuals_sql("c_acctbal")),
}
