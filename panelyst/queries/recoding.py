"""Recoding, derivation and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyst.functions import scalars as S
from panelyst.operators import recode as R
from panelyst.queries.base import table

_PRIORITY = {"1-URGENT": "High", "2-HIGH": "High", "3-MEDIUM": "Neutral", "5-LOW": "Low"}
_PRIORITY_SQL = """CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'High'
  WHEN o_orderpriority = '3-MEDIUM' THEN 'Neutral' WHEN o_orderpriority = '5-LOW' THEN 'Low'
  ELSE o_orderpriority END"""


def recode_map(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", R.recode("o_orderpriority", _PRIORITY).alias("priority"))


def recode_codes(spark, sf):
    c = table(spark, sf, "customer")
    codes = {i: f"Site {i % 4}" for i in range(20)}
    return c.select("c_custkey", R.recode("c_nationkey", codes).alias("site"))


def recode_override(spark, sf):
    o = table(spark, sf, "orders")
    recoded = F.when(F.col("o_totalprice") > 450000, F.lit("Adjudicated"))
    return o.select("o_orderkey", R.override(recoded, R.recode("o_orderpriority", _PRIORITY)).alias("priority"))


def rule_ladder(spark, sf):
    p = table(spark, sf, "part").withColumn("size", F.when(F.col("p_size") != 13, F.col("p_size")))
    rule = R.ladder(
        [
            (F.col("size") == 1, "One"),
            ((F.col("p_type") == "PROMO") & (F.col("size") > 30), "Large promo"),
            (F.col("size") > 40, "Large"),
            (F.col("p_name").rlike("^red"), F.col("p_brand")),
        ],
        "Other",
    )
    return p.select("p_partkey", rule.alias("class"))


_LEVELS = {"Auto": "AUTOMOBILE", "Build": "BUILDING", "Furn": "FURNITURE", "House": "HOUSEHOLD", "Mach": "MACHINERY"}


def dummy_code(spark, sf):
    c = table(spark, sf, "customer").withColumn(
        "segment", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    )
    return c.select("c_custkey").join(
        c.withColumns(R.dummies("segment", "SEG", _LEVELS, "Auto")).drop(
            "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "segment"
        ),
        "c_custkey",
    )


def _boxes(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(
        *[
            F.max(((F.col("event_type") == t) & (F.col("value") > 200)).cast("int")).alias(t)
            for t in ("click", "error", "purchase", "signup", "view")
        ],
        F.max(F.when(F.col("value") > 300, F.col("event_type"))).alias("txt"),
    )


_BOXES = (
    "SELECT user_id, "
    + ", ".join(
        f"max(CAST(event_type = '{t}' AND value > 200 AS INTEGER)) AS {t}"
        for t in ("click", "error", "purchase", "signup", "view")
    )
    + ", max(CASE WHEN value > 300 THEN event_type END) AS txt FROM events GROUP BY user_id"
)


def multi_select_flags(spark, sf):
    b = _boxes(spark, sf)
    flags = {
        "FLAG_browse": R.multi_select(["click", "view"], "txt", "sign"),
        "FLAG_buy": R.multi_select(["purchase", "signup"], "txt", "pur"),
        "FLAG_missing": R.not_among("error", [0]),
    }
    b = b.withColumns(flags)
    b = b.withColumn("FLAG_none", R.none_of(list(flags)))
    return b.withColumn("FLAG_any", R.complement("FLAG_none")).select(
        "user_id", *flags, "FLAG_none", "FLAG_any"
    )


def median_split(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey",
        S.log_plus_one(
            F.when(F.col("c_acctbal") < 0, 0.0).when(F.col("c_acctbal") <= 9000, F.col("c_acctbal"))
        ).alias("money"),
    )
    return R.median_split(c, "money", "money_cat").select("c_custkey", "money_cat")


def age_band(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", S.age_years(F.lit("2024-03-01").cast("date"), F.col("o_orderdate").cast("date")).alias("age")
    )
    return o.withColumn("age_group", R.band("age", [24, 27], ["under 24", "24-26", "27 and over"]))


def dates(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("day"), (F.col("o_custkey") % 400).cast("int").alias("code")
    )
    born = F.lit("1996-07-01").cast("date")
    return o.select(
        "o_orderkey",
        S.from_day_number(F.datediff("day", F.lit("1960-01-01").cast("date"))).alias("from_number"),
        S.parse_date(F.date_format("day", "yyyy-MM-dd")).alias("parsed"),
        S.parse_date(F.date_format("day", "dd.MM.yyyy")).alias("no_date"),
        F.year("day").alias("year"),
        S.days_before(F.lit("1998-01-01").cast("date"), "day").alias("days"),
        S.within_days(F.lit("1998-01-01").cast("date"), "day").cast("int").alias("in_window"),
        R.years_since_event("day", F.when(F.col("code") < 10, 2099).otherwise(F.lit(1990)), 2099, F.lit(-1)).alias("since"),
        R.same_year(F.year("day"), F.year(born)).alias("born_then"),
    )


def log_and_round(spark, sf):
    c = table(spark, sf, "customer")
    owned = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    return c.select(
        "c_custkey",
        S.round_to(S.log_plus_one(owned), 6).alias("log_balance"),
        F.floor("c_acctbal").alias("whole"),
        S.ratio("c_acctbal", "c_nationkey").alias("per_nation"),
    )


def text_functions(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey",
        S.entity_key("p_brand", "p_size").alias("site_pid"),
        S.key_part(S.entity_key("p_brand", "p_size"), 2).alias("pid"),
        S.replace_text("p_name", "^(\\w+) (\\w+)$", "$2, $1").alias("swapped"),
        S.extract_text("p_brand", "#(\\d\\d)$").alias("two_digits"),
        S.percent_text(F.col("p_size") / F.lit(60.0)).alias("pct"),
    )


QUERIES = {
    "recode_map": (recode_map, f"SELECT o_orderkey, {_PRIORITY_SQL} AS priority FROM orders"),
    "recode_codes": (
        recode_codes,
        """SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN 'Site ' || (c_nationkey % 4)
  ELSE c_nationkey::VARCHAR END AS site FROM customer""",
    ),
    "recode_override": (
        recode_override,
        f"""SELECT o_orderkey, CASE WHEN o_totalprice > 450000 THEN 'Adjudicated' ELSE {_PRIORITY_SQL} END AS priority
  FROM orders""",
    ),
    "rule_ladder": (
        rule_ladder,
        """SELECT p_partkey, CASE WHEN size = 1 THEN 'One' WHEN p_type = 'PROMO' AND size > 30 THEN 'Large promo'
  WHEN size > 40 THEN 'Large' WHEN p_name LIKE 'red%' THEN p_brand ELSE 'Other' END AS class
  FROM (SELECT *, CASE WHEN p_size <> 13 THEN p_size END AS size FROM part)""",
    ),
    "dummy_code": (
        dummy_code,
        "SELECT c_custkey, "
        + ", ".join(
            f"CASE WHEN c_acctbal >= 0 THEN CAST(c_mktsegment = '{lev}' AS INTEGER) END "
            f'AS "SEG_{"RCR" if k == "Auto" else "RCD"}_{k}"'
            for k, lev in _LEVELS.items()
        )
        + " FROM customer",
    ),
    "multi_select_flags": (
        multi_select_flags,
        f"""WITH f AS (SELECT user_id,
  CAST(click = 1 OR view = 1 OR coalesce(regexp_matches(txt, 'sign'), false) AS INTEGER) AS "FLAG_browse",
  CAST(purchase = 1 OR signup = 1 OR coalesce(regexp_matches(txt, 'pur'), false) AS INTEGER) AS "FLAG_buy",
  CAST(error <> 0 AS INTEGER) AS "FLAG_missing" FROM ({_BOXES})),
g AS (SELECT *, CAST("FLAG_browse" = 0 AND "FLAG_buy" = 0 AND "FLAG_missing" = 0 AS INTEGER) AS "FLAG_none" FROM f)
SELECT *, 1 - "FLAG_none" AS "FLAG_any" FROM g""",
    ),
    "median_split": (
        median_split,
        """WITH m AS (SELECT c_custkey, ln(1 + CASE WHEN c_acctbal < 0 THEN 0.0::DOUBLE
    WHEN c_acctbal <= 9000 THEN c_acctbal END) AS money FROM customer),
t AS (SELECT quantile_cont(money, 0.5) AS cut FROM m WHERE money <> 0)
SELECT c_custkey, CASE WHEN money IS NULL THEN 'Don''t know' WHEN money = 0 THEN 'Zero'
  WHEN money < cut THEN 'Low' ELSE 'High' END AS money_cat FROM m CROSS JOIN t""",
    ),
    "age_band": (
        age_band,
        """SELECT *, CASE WHEN age < 24 THEN 'under 24' WHEN age < 27 THEN '24-26' ELSE '27 and over' END AS age_group
  FROM (SELECT o_orderkey,
  CAST(floor(date_diff('day', o_orderdate::DATE, DATE '2024-03-01') / 365.25) AS INTEGER) AS age FROM orders)""",
    ),
    "dates": (
        dates,
        """SELECT o_orderkey, o_orderdate::DATE AS from_number, o_orderdate::DATE AS parsed, CAST(NULL AS DATE) AS no_date,
  CAST(year(o_orderdate) AS INTEGER) AS year,
  CAST(date_diff('day', o_orderdate::DATE, DATE '1998-01-01') AS INTEGER) AS days,
  CAST(date_diff('day', o_orderdate::DATE, DATE '1998-01-01') BETWEEN 0 AND 183 AS INTEGER) AS in_window,
  CASE WHEN o_custkey % 400 < 10 THEN -1 ELSE CAST(year(o_orderdate) AS INTEGER) - 1990 END AS since,
  CAST(year(o_orderdate) = 1996 AS INTEGER) AS born_then FROM orders""",
    ),
    "log_and_round": (
        log_and_round,
        """SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(ln(1 + c_acctbal), 6) END AS log_balance, CAST(floor(c_acctbal) AS BIGINT) AS whole,
  CASE WHEN c_nationkey <> 0 THEN c_acctbal / c_nationkey END AS per_nation
  FROM customer""",
    ),
    "text_functions": (
        text_functions,
        """SELECT p_partkey, p_brand || '_' || p_size AS site_pid, p_size::VARCHAR AS pid,
  split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1) AS swapped,
  nullif(regexp_extract(p_brand, '#([0-9][0-9])$', 1), '') AS two_digits,
  printf('%.1f', 100 * (p_size / 60.0::DOUBLE)) || '%' AS pct FROM part""",
    ),
}
