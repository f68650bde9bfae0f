"""Summary tables: one factor, many binary, continuous, sizes and the report."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelyst.operators import tables as T
from panelyst.queries.base import (
    PARTICIPANTS,
    participants,
    round_cols,
    round_mean_sql,
    round_means,
    table,
)

_SPECIAL = "('Skipped', 'Refuse to answer', 'Missing')"


def factor_sql(
    base: str, header: str, n: int | None = None, keep: tuple[str, ...] = (), groups: list[str] | None = None
) -> str:
    """SQL twin of a one-factor block; ``base`` yields (grp, level)."""
    seen = "SELECT grp, count(*) AS total FROM f WHERE grp IS NOT NULL GROUP BY grp"
    if groups is not None:
        listed = ", ".join(f"('{g}')" for g in groups)
        seen = f"SELECT g AS grp, coalesce(total, 0) AS total FROM (VALUES {listed}) v(g) LEFT JOIN ({seen}) t ON g = grp"
    if n is None:
        level = "level"
        ranks = ""
    else:
        kept = "(" + ", ".join(f"'{k}'" for k in (*keep, "")) + ")"
        ranks = f""",
rk AS (SELECT level, row_number() OVER (ORDER BY count(*) DESC, level) AS pos, count(*) OVER () AS levels
       FROM f0 WHERE level NOT IN {kept} GROUP BY level)"""
        level = f"""CASE WHEN level IN {kept} THEN level
       WHEN (SELECT max(levels) FROM rk) <= {n + 1} THEN level
       WHEN level IN (SELECT level FROM rk WHERE pos <= {n}) THEN level ELSE 'Other' END"""
    return f"""
WITH d AS ({base}),
f0 AS (SELECT * FROM d WHERE level IS NOT NULL AND level NOT IN {_SPECIAL}){ranks},
f AS (SELECT grp, {level} AS level FROM f0),
lv AS (SELECT level, count(*) AS level_n FROM f GROUP BY level),
gt AS ({seen}),
cell AS (SELECT grp, level, count(*) AS n FROM f GROUP BY grp, level),
cells AS (
  SELECT level, level_n, CAST(NULL AS VARCHAR) AS grp, 1 AS is_overall, level_n AS n,
         (SELECT count(*) FROM f) AS total FROM lv
  UNION ALL
  SELECT lv.level, level_n, gt.grp, 0, coalesce(cell.n, 0), gt.total
  FROM lv CROSS JOIN gt LEFT JOIN cell ON cell.grp = gt.grp AND cell.level = lv.level)
SELECT '{header}' AS header, level, level_n, grp, is_overall, n, total,
       CASE WHEN total > 0 THEN CAST(n AS DOUBLE) / total END AS share FROM cells"""


def one_factor_table(spark, sf):
    return T.one_factor_table(participants(spark, sf), "r_name", "c_mktsegment", header="Segment")


def one_factor_zero_cells(spark, sf):
    # On most days some priority is not seen, so (day, priority) has empty cells.
    o = table(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return T.one_factor_table(o, "day", "o_orderpriority", header="Priority")


def one_factor_lump(spark, sf):
    p = table(spark, sf, "part")
    return T.one_factor_table(p, "p_type", "p_brand", header="Brand", n=5, keep=["Brand#6", "Brand#24"])


def one_factor_free_text(spark, sf):
    """A factor of very many levels: lumped before it is counted."""
    o = table(spark, sf, "orders")
    return T.one_factor_table(o, "o_orderpriority", "o_custkey", header="Customer", n=5, keep=["7"], free_text=True)


def one_factor_lump_n_plus_one(spark, sf):
    p = participants(spark, sf)
    return T.one_factor_table(p, "r_name", "c_mktsegment", header="Segment", n=4)


def one_factor_special_levels(spark, sf):
    o = table(spark, sf, "orders").withColumn(
        "answer",
        F.when(F.col("o_orderpriority") == "5-LOW", "Refuse to answer")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Skipped")
        .when(F.col("o_totalprice") > 400000, F.lit(None))
        .otherwise(F.col("o_orderpriority")),
    )
    return T.one_factor_table(o, "o_orderstatus", "answer", header="Answer")


_MULTI = {"c_mktsegment": "Segment", "balance": "Balance", "n_name": "Nation"}


def _with_balance(spark, sf):
    return participants(spark, sf).withColumn(
        "balance", F.when(F.col("c_acctbal") < 0, "negative").when(F.col("c_acctbal") < 5000, "low").otherwise("high")
    )


_BALANCE = f"""SELECT *, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal < 5000 THEN 'low'
  ELSE 'high' END AS balance FROM ({PARTICIPANTS})"""


def one_factor_many(spark, sf):
    return T.one_factor_tables(_with_balance(spark, sf), "r_name", _MULTI)


_NAMED = ("Brand#9", "Brand#2")


def level_order(spark, sf):
    """Display order of a lumped block: two named brands first, kept ones after the others, Other last."""
    block = one_factor_lump(spark, sf)
    ranked = T.level_ranks(block, _NAMED, ["Brand#6", "Brand#24"], lumped=True)
    return ranked.where("is_overall = 1").select("header", "level", "level_rank")


def _with_other(spark, sf):
    # The statuses of a survey may hold an ordinary answer of that name.
    o = table(spark, sf, "orders").withColumn(
        "answer", F.when(F.col("o_orderpriority") == "3-MEDIUM", T.OTHER).otherwise(F.col("o_orderpriority"))
    )
    return T.one_factor_table(o, "o_orderstatus", "answer", header="Answer")


def level_order_unlumped(spark, sf):
    """Rows of a block that was not lumped, by their place: an ordinary level called Other stands by its frequency."""
    ranked = T.level_ranks(_with_other(spark, sf), ["5-LOW"], lumped=False)
    place = W.partitionBy("header").orderBy("level_rank", F.desc("is_overall"), "grp")
    return ranked.select("level", "grp", "n", "level_rank", F.row_number().over(place).alias("place"))


def _order_sql(block: str, named: tuple[str, ...], keep: tuple[str, ...], lumped: bool) -> str:
    first = " ".join(f"WHEN '{x}' THEN {k}" for k, x in enumerate(named, 1))
    last = "".join(f"WHEN '{x}' THEN 1 " for x in keep) + ("WHEN 'Other' THEN 2 " if lumped else "")
    last = f"CASE level {last}ELSE 0 END" if last else "0"
    return f"""SELECT header, level, row_number() OVER (PARTITION BY header
  ORDER BY CASE level {first} ELSE 99 END, {last}, level_n DESC, level) AS level_rank
  FROM ({block}) WHERE is_overall = 1"""


def top_levels(spark, sf):
    counts = table(spark, sf, "part").groupBy(F.col("p_brand").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return T.top_levels(counts, 10)


def _ticks(spark, sf):
    e = table(spark, sf, "events")
    per_user = e.groupBy("user_id").agg(
        *[
            F.least(F.count_if((F.col("event_type") == t) & (F.col("value") > 160)), F.lit(2)).cast("int").alias(t)
            for t in _TYPES
        ]
    )
    c = participants(spark, sf)
    return per_user.join(c, per_user.user_id == c.c_custkey)


_TYPES = ("click", "error", "purchase", "signup", "view")
_LABELS = {t: t.capitalize() for t in _TYPES}
_TICKS = f"""SELECT r_name AS grp, u.* FROM (SELECT user_id, {", ".join(
    f"CAST(least(count(*) FILTER (WHERE event_type = '{t}' AND value > 160), 2) AS INTEGER) AS {t}" for t in _TYPES
)} FROM events GROUP BY user_id) u JOIN ({PARTICIPANTS}) p ON user_id = c_custkey"""


def binary_sql(
    rows: str, variables: dict[str, str], header: str, n: int | None = None, keep: tuple[str, ...] = ()
) -> str:
    """SQL twin of a check-box block; ``rows`` yields grp and the boxes."""
    boxes = list(variables)
    loose = [t for t in boxes if t not in keep]
    all01 = " AND ".join(f'"{t}" IN (0, 1)' for t in boxes)
    ranked = " UNION ALL ".join(
        f"SELECT '{t}' AS v, {i} AS p, (SELECT sum(\"{t}\") FROM x) AS s" for i, t in enumerate(loose)
    )
    longs = " UNION ALL ".join(
        f"SELECT grp, '{t}' AS variable, '{variables[t]}' AS level, \"{t}\" AS y FROM x" for t in boxes
    )
    if n is not None:
        kept = ", ".join(repr(k) for k in (*keep, ""))
        longs = (
            f"SELECT * FROM ({longs}) WHERE variable IN (SELECT v FROM top WHERE pos <= {n}) OR variable IN ({kept})"
            + " UNION ALL SELECT grp, 'Other', 'Other', greatest("
            + ", ".join(f"CASE WHEN '{t}' IN (SELECT v FROM top WHERE pos <= {n}) THEN 0 ELSE \"{t}\" END" for t in loose)
            + ") FROM x"
        )
    return f"""
WITH x AS (SELECT * FROM ({rows}) WHERE {all01}),
top AS (SELECT v, row_number() OVER (ORDER BY s DESC, p) AS pos FROM ({ranked})),
l AS ({longs}),
tot AS (SELECT variable, sum(y) AS level_n FROM l GROUP BY variable),
c AS (SELECT variable, level, CAST(NULL AS VARCHAR) AS grp, 1 AS is_overall, sum(y) AS n, count(*) AS total
      FROM l GROUP BY variable, level
      UNION ALL SELECT variable, level, grp, 0, sum(y), count(*) FROM l GROUP BY variable, level, grp)
SELECT '{header}' AS header, variable, level, CAST(level_n AS BIGINT) AS level_n, grp, is_overall,
       CAST(n AS BIGINT) AS n, total, CAST(n AS DOUBLE) / total AS share
FROM c JOIN tot USING (variable)"""


def many_binary_table(spark, sf):
    return T.many_binary_table(_ticks(spark, sf), "r_name", _LABELS, "Events")


def many_binary_lump(spark, sf):
    return T.many_binary_table(_ticks(spark, sf), "r_name", _LABELS, "Events", n=1, keep=["signup"])


def _visits(spark, sf):
    return participants(spark, sf).join(
        table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey")
    )


_VISITS = f"SELECT * FROM ({PARTICIPANTS}) JOIN orders ON c_custkey = o_custkey"


def continuous_mean(spark, sf):
    t = T.continuous_tables(
        _visits(spark, sf), "n_name", {"o_totalprice": "Price", "c_acctbal": "Balance"}, "mean"
    )
    return round_means(t, "mean", "sd")


def mean_sql(base: str, group: str, variables: dict[str, str]) -> str:
    blocks = []
    for v, label in variables.items():
        for g, flag in ((group, 0), ("CAST(NULL AS VARCHAR)", 1)):
            blocks.append(
                f"""SELECT '{v}' AS variable, {g} AS grp, {flag} AS is_overall, count({v}) AS n,
  {round_mean_sql(f"avg({v})")} AS mean, {round_mean_sql(f"stddev_samp({v})")} AS sd,
  CAST((SELECT min({v}) FROM b) AS DOUBLE) AS range_min, CAST((SELECT max({v}) FROM b) AS DOUBLE) AS range_max,
  '{label}' AS header FROM b"""
                + (f" WHERE {group} IS NOT NULL GROUP BY {group}" if flag == 0 else "")
            )
    return f"WITH b AS ({base}) " + " UNION ALL ".join(blocks)


def continuous_median(spark, sf):
    t = T.continuous_tables(_visits(spark, sf), "r_name", {"o_totalprice": "Price"}, "median")
    return round_cols(t, 4, "median", "q25", "q75")


def median_sql(base: str, group: str, v: str, label: str) -> str:
    blocks = []
    for g, flag in ((group, 0), ("CAST(NULL AS VARCHAR)", 1)):
        blocks.append(
            f"""SELECT '{v}' AS variable, {g} AS grp, {flag} AS is_overall, count({v}) AS n,
  round(quantile_cont({v}, 0.5), 4) AS median, round(quantile_cont({v}, 0.25), 4) AS q25,
  round(quantile_cont({v}, 0.75), 4) AS q75,
  CAST((SELECT min({v}) FROM b) AS DOUBLE) AS range_min, CAST((SELECT max({v}) FROM b) AS DOUBLE) AS range_max,
  '{label}' AS header FROM b"""
            + (f" GROUP BY {group}" if flag == 0 else "")
        )
    return f"WITH b AS ({base}) " + " UNION ALL ".join(blocks)


def group_sizes(spark, sf):
    return T.group_sizes(participants(spark, sf), "r_name")


def formatted_wide_table(spark, sf):
    groups = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    t = T.one_factor_table(participants(spark, sf), "r_name", "c_mktsegment", header="Segment", groups=groups)
    return T.wide(T.formatted(t), ["header", "level"], groups)


def _pct(n: str, total: str) -> str:
    return f"printf('%.1f', 100.0 * {n} / {total}) || '%)'"


_WIDE = f"""
WITH b AS ({PARTICIPANTS}), t AS (SELECT count(*) AS total FROM b)
SELECT 'Segment' AS header, c_mktsegment AS level,
  count(*) || '/' || max(total) || ' (' || {_pct("count(*)", "max(total)")} AS "Overall",
  {", ".join(
    f'''count(*) FILTER (WHERE r_name = '{g}') || ' (' || {_pct(f"count(*) FILTER (WHERE r_name = '{g}')", f"(SELECT count(*) FROM b WHERE r_name = '{g}')")} AS "{g}"'''
    for g in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
  )}
FROM b CROSS JOIN t GROUP BY c_mktsegment"""


def report_assembly(spark, sf):
    people = _with_balance(spark, sf)
    factor = T.one_factor_tables(people, "r_name", {"c_mktsegment": "Segment", "balance": "Balance"})
    means = round_means(T.continuous_tables(people, "r_name", {"c_acctbal": "Account"}, "mean"), "mean", "sd")
    ticks = T.many_binary_table(_ticks(spark, sf), "r_name", _LABELS, "Events")
    return T.report({"Table 1": [factor, means], "Table 2": [ticks]}).select(
        "table", "block", "header", "level", "grp", "is_overall", "n", "total", "share", "mean", "sd"
    )


_REPORT = f"""
WITH f1 AS ({factor_sql(f"SELECT r_name AS grp, c_mktsegment AS level FROM ({_BALANCE})", "Segment")}),
f2 AS ({factor_sql(f"SELECT r_name AS grp, balance AS level FROM ({_BALANCE})", "Balance")}),
m AS ({mean_sql(PARTICIPANTS, "r_name", {"c_acctbal": "Account"})}),
y AS ({binary_sql(_TICKS, _LABELS, "Events")})
SELECT 'Table 1' AS "table", 1 AS block, header, level, grp, is_overall, n, total, share,
  CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS sd FROM (SELECT * FROM f1 UNION ALL SELECT * FROM f2)
UNION ALL SELECT 'Table 1', 2, header, NULL, grp, is_overall, n, NULL, NULL, mean, sd FROM m
UNION ALL SELECT 'Table 2', 1, header, level, grp, is_overall, n, total, share, NULL, NULL FROM y"""


_LUMP = factor_sql("SELECT p_type AS grp, p_brand AS level FROM part", "Brand", 5, ("Brand#6", "Brand#24"))
_OTHER = factor_sql(
    """SELECT o_orderstatus AS grp, CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'Other' ELSE o_orderpriority END AS level
  FROM orders""",
    "Answer",
)

QUERIES = {
    "one_factor_table": (
        one_factor_table,
        factor_sql(f"SELECT r_name AS grp, c_mktsegment AS level FROM ({PARTICIPANTS})", "Segment"),
    ),
    "one_factor_zero_cells": (
        one_factor_zero_cells,
        factor_sql(
            "SELECT strftime(o_orderdate, '%Y-%m-%d') AS grp, o_orderpriority AS level FROM orders",
            "Priority",
        ),
    ),
    "one_factor_lump": (
        one_factor_lump,
        _LUMP,
    ),
    "one_factor_free_text": (
        one_factor_free_text,
        factor_sql("SELECT o_orderpriority AS grp, o_custkey::VARCHAR AS level FROM orders", "Customer", 5, ("7",)),
    ),
    "level_order": (level_order, _order_sql(_LUMP, _NAMED, ("Brand#6", "Brand#24"), True)),
    "level_order_unlumped": (
        level_order_unlumped,
        f"""SELECT level, grp, n, level_rank, row_number() OVER (ORDER BY level_rank, is_overall DESC, grp) AS place
  FROM ({_OTHER}) JOIN ({_order_sql(_OTHER, ("5-LOW",), (), False)}) USING (header, level)""",
    ),
    "one_factor_lump_n_plus_one": (
        one_factor_lump_n_plus_one,
        factor_sql(f"SELECT r_name AS grp, c_mktsegment AS level FROM ({PARTICIPANTS})", "Segment", 4),
    ),
    "one_factor_special_levels": (
        one_factor_special_levels,
        factor_sql(
            """SELECT o_orderstatus AS grp, CASE WHEN o_orderpriority = '5-LOW' THEN 'Refuse to answer'
  WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Skipped' WHEN o_totalprice > 400000 THEN NULL
  ELSE o_orderpriority END AS level FROM orders""",
            "Answer",
        ),
    ),
    "one_factor_many": (
        one_factor_many,
        " UNION ALL ".join(
            f"SELECT * FROM ({factor_sql(f'SELECT r_name AS grp, {c} AS level FROM ({_BALANCE})', h)})"
            for c, h in _MULTI.items()
        ),
    ),
    "top_levels": (
        top_levels,
        """SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, p_brand) AS INTEGER) AS rank, p_brand AS level,
  count(*) AS n FROM part GROUP BY p_brand QUALIFY rank <= 10""",
    ),
    "many_binary_table": (many_binary_table, binary_sql(_TICKS, _LABELS, "Events")),
    "many_binary_lump": (many_binary_lump, binary_sql(_TICKS, _LABELS, "Events", 1, ("signup",))),
    "continuous_mean": (
        continuous_mean,
        mean_sql(_VISITS, "n_name", {"o_totalprice": "Price", "c_acctbal": "Balance"}),
    ),
    "continuous_median": (continuous_median, median_sql(_VISITS, "r_name", "o_totalprice", "Price")),
    "group_sizes": (
        group_sizes,
        f"""SELECT grp, n, is_overall, coalesce(grp, 'Overall') || ' (N=' || n || ')' AS heading FROM (
  SELECT r_name AS grp, count(*) AS n, 0 AS is_overall FROM ({PARTICIPANTS}) GROUP BY r_name
  UNION ALL SELECT NULL, count(*), 1 FROM ({PARTICIPANTS}))""",
    ),
    "formatted_wide_table": (formatted_wide_table, _WIDE),
    "report_assembly": (report_assembly, _REPORT),
}
