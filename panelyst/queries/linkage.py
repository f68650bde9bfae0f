"""Wave linkage, chart facts, re-keying and questionnaire versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyst.operators import link as L
from panelyst.queries.base import table

KEYS = ["site", "pid"]


def _baseline(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("site"), F.col("c_custkey").cast("string").alias("pid"), "c_acctbal"
    )


def _followup(spark, sf):
    """Customers who ordered in 2001, one row each."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    late = (
        o.where(F.year("o_orderdate") == 2001)
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("top_price"))
    )
    return late.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("site"), F.col("c_custkey").cast("string").alias("pid"), "n_orders", "top_price"
    )


_BASE = "SELECT c_nationkey AS site, c_custkey::VARCHAR AS pid, c_acctbal FROM customer"
_FOLLOW = """SELECT c_nationkey AS site, c_custkey::VARCHAR AS pid, n_orders, top_price FROM (
  SELECT o_custkey, count(*) AS n_orders, max(o_totalprice) AS top_price FROM orders
  WHERE year(o_orderdate) = 2001 GROUP BY o_custkey) JOIN customer ON o_custkey = c_custkey"""


def link_waves(spark, sf):
    return L.link_waves(_baseline(spark, sf), _followup(spark, sf), KEYS)


def link_waves_null_keys(spark, sf):
    blank = F.when(F.col("site") != 5, F.col("site"))
    base = _baseline(spark, sf).withColumn("site", blank)
    follow = _followup(spark, sf).withColumn("site", blank)
    return L.link_waves(base, follow, KEYS, null_safe=True)


def retained_rows(spark, sf):
    return L.retained(_baseline(spark, sf), _followup(spark, sf), KEYS)


def lost_rows(spark, sf):
    return L.lost(_baseline(spark, sf), _followup(spark, sf), KEYS)


def orphan_followups(spark, sf):
    return L.orphans(_followup(spark, sf), _baseline(spark, sf).where("site >= 3"), KEYS)


def key_overlap(spark, sf):
    return L.key_overlap(_baseline(spark, sf).where("c_acctbal < 0"), _followup(spark, sf), KEYS)


def duplicate_keys(spark, sf):
    return L.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def attach_lookup(spark, sf):
    codes = table(spark, sf, "nation").select(F.col("n_nationkey").alias("site"), "n_name").where("site < 20")
    return L.attach(_baseline(spark, sf), codes, ["site"])


def attach_full(spark, sf):
    left = table(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_done")
    )
    right = table(spark, sf, "orders").where("o_orderpriority = '5-LOW'").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_low")
    )
    return L.attach(left, right, ["o_custkey"], how="full")


def rekey_subgroup(spark, sf):
    c = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("site"), F.col("c_custkey").alias("local_id"), "c_acctbal"
    )
    xwalk = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("local_id"), F.concat(F.lit("P"), F.col("s_suppkey") + 1000).alias("pid")
    )
    return L.rekey_subgroup(c, xwalk, F.col("site") == "BUILDING", "local_id", "pid", out="pid")


def first_value_by_date(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_custkey",
        "o_orderkey",
        F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderstatus")).alias("result"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderdate").cast("date")).alias("day"),
    )
    return L.first_value_by_date(o, ["o_custkey"], "result", "day", ["o_orderkey"])


def visit_in_window(spark, sf):
    index = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("pid"),
        F.when(
            F.col("c_custkey") % 11 != 0,
            F.date_add(F.lit("1997-01-01").cast("date"), (F.col("c_custkey") % 900).cast("int")),
        ).alias("today"),
    )
    visits = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("pid"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate").cast("date")).alias("day"),
    )
    return L.visit_in_window(index, visits, ["pid"], "today", "day")


def harmonise_versions(spark, sf):
    old = F.col("o_orderstatus") == "F"
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.when(old, F.substring("o_orderpriority", 1, 1)).alias("Q_24L"),
        F.when(old, F.month("o_orderdate")).alias("Q_24M"),
        F.when(~old, F.substring("o_orderpriority", 1, 1)).alias("Q_24XL"),
        F.when(~old, F.month("o_orderdate")).alias("Q_24XM"),
    )
    return L.harmonise_versions(o, {"Q_24XL": "Q_24L", "Q_24XM": "Q_24M"}, F.col("Q_24L").isNotNull())


def stack_unlike(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return L.stack(c, s)


def other_text(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_size") < 10, "[Skipped]").otherwise(F.col("p_name")).alias("NAMES"),
        F.when(F.col("p_size") < 40, "[Skipped]").when(F.col("p_size") < 48, F.col("p_type")).alias("TYPES"),
    )
    return L.other_text(p, ["p_partkey"], ["NAMES", "TYPES"])


QUERIES = {
    "link_waves": (
        link_waves,
        f"""SELECT b.site, b.pid, b.c_acctbal, f.n_orders, f.top_price,
  CASE WHEN f.pid IS NULL THEN 0 ELSE 1 END AS "Set" FROM ({_BASE}) b LEFT JOIN ({_FOLLOW}) f USING (site, pid)""",
    ),
    "link_waves_null_keys": (
        link_waves_null_keys,
        f"""SELECT b.site, b.pid, b.c_acctbal, f.n_orders, f.top_price,
  CASE WHEN f.pid IS NULL THEN 0 ELSE 1 END AS "Set"
  FROM (SELECT * REPLACE (nullif(site, 5) AS site) FROM ({_BASE})) b
  LEFT JOIN (SELECT * REPLACE (nullif(site, 5) AS site) FROM ({_FOLLOW})) f
  ON b.site IS NOT DISTINCT FROM f.site AND b.pid = f.pid""",
    ),
    "retained_rows": (
        retained_rows,
        f"SELECT b.*, f.n_orders, f.top_price FROM ({_BASE}) b JOIN ({_FOLLOW}) f USING (site, pid)",
    ),
    "lost_rows": (
        lost_rows,
        f"SELECT * FROM ({_BASE}) WHERE (site, pid) NOT IN (SELECT site, pid FROM ({_FOLLOW}))",
    ),
    "orphan_followups": (orphan_followups, f"SELECT * FROM ({_FOLLOW}) WHERE site < 3"),
    "key_overlap": (
        key_overlap,
        f"""SELECT site, pid FROM ({_BASE}) WHERE c_acctbal < 0
  AND (site, pid) IN (SELECT site, pid FROM ({_FOLLOW}))""",
    ),
    "duplicate_keys": (
        duplicate_keys,
        "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    ),
    "attach_lookup": (
        attach_lookup,
        f"SELECT b.*, n_name FROM ({_BASE}) b LEFT JOIN nation ON site = n_nationkey AND n_nationkey < 20",
    ),
    "attach_full": (
        attach_full,
        """SELECT o_custkey, n_done, n_low FROM
  (SELECT o_custkey, count(*) AS n_done FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
  FULL JOIN (SELECT o_custkey, count(*) AS n_low FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY o_custkey)
  USING (o_custkey)""",
    ),
    "rekey_subgroup": (
        rekey_subgroup,
        """SELECT c_mktsegment AS site, c_acctbal, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey::VARCHAR
  WHEN s_suppkey IS NOT NULL THEN 'P' || (s_suppkey + 1000) END AS pid
  FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""",
    ),
    "first_value_by_date": (
        first_value_by_date,
        """SELECT o_custkey, CASE WHEN day IS NOT NULL THEN o_orderstatus END AS result FROM (
  SELECT *, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderdate END AS day FROM orders
  WHERE o_orderpriority <> '3-MEDIUM')
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY day NULLS LAST, o_orderkey) = 1""",
    ),
    "visit_in_window": (
        visit_in_window,
        """WITH i AS (SELECT c_custkey AS pid,
  CASE WHEN c_custkey % 11 <> 0 THEN DATE '1997-01-01' + CAST(c_custkey % 900 AS INTEGER) END AS today FROM customer),
v AS (SELECT o_custkey AS pid, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate::DATE END AS day FROM orders),
j AS (SELECT i.pid, date_diff('day', day, today) BETWEEN 0 AND 183 AS p FROM i LEFT JOIN v USING (pid))
SELECT pid, CASE WHEN bool_or(p) THEN 1 WHEN count(*) > count(p) THEN NULL ELSE 0 END AS visited
FROM j GROUP BY pid""",
    ),
    "harmonise_versions": (
        harmonise_versions,
        """SELECT o_orderkey, o_orderstatus, left(o_orderpriority, 1) AS "Q_24XL",
  CAST(month(o_orderdate) AS INTEGER) AS "Q_24XM" FROM orders""",
    ),
    "stack_unlike": (
        stack_unlike,
        """SELECT c_custkey AS id, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
  UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier""",
    ),
    "other_text": (
        other_text,
        """SELECT p_partkey, 'NAMES' AS question, p_name AS answer FROM part WHERE p_size >= 10
  UNION ALL SELECT p_partkey, 'TYPES', p_type FROM part WHERE p_size BETWEEN 40 AND 47""",
    ),
}
