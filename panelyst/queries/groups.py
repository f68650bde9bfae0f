"""Counts, shares and quantiles per group."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyst.functions.nulls import agg_sum0
from panelyst.operators import groups as G
from panelyst.operators.quantiles import exact_quantiles
from panelyst.queries.base import (
    BATTERY,
    PARTICIPANTS,
    battery,
    labelled_documents,
    participants,
    round_cols,
    round_mean_sql,
    round_means,
    table,
)


def counts_overall_and_group(spark, sf):
    p = participants(spark, sf).withColumn("region", F.when(F.col("r_name") != "ASIA", F.col("r_name")))
    return round_means(
        G.overall_and_by_group(
            p, "region", n=F.count(F.lit(1)), mean=F.avg("c_acctbal"), low=F.min("c_acctbal"), high=F.max("c_acctbal")
        ),
        "mean",
    )


def share_of_group(spark, sf):
    counts = G.frequency(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])
    return G.share_of_group(counts, "n", ["o_orderstatus"])


def group_max(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return G.group_max(c, "c_acctbal", ["c_nationkey"], "best")


def frequency_without_null(spark, sf):
    return G.frequency(labelled_documents(spark, sf), ["lang", "quality"])


def crosstab_zero_cells(spark, sf):
    levels = ["en", "de", "fr", "es", "xx"]
    return G.crosstab(labelled_documents(spark, sf), "lang", "quality", levels, ["0", "1"])


def conditional_counts(spark, sf):
    d = labelled_documents(spark, sf)
    return G.conditional_counts(
        d,
        {
            "n_labelled": F.col("quality").isNotNull(),
            "n_good": F.col("quality") == 1,
            "n_long": F.length("text") > 1000,
            "n_digits": F.col("text").rlike("[0-9]{4}"),
        },
        ["lang"],
    )


def footnote_counts(spark, sf):
    d = labelled_documents(spark, sf)
    return G.conditional_counts(
        d, {"n_known": F.col("quality").isNotNull(), "n_toxic": F.col("toxic") == 1}
    )


def any_true_per_key(spark, sf):
    b = battery(spark, sf).join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return G.any_true(b, ["o_custkey"], F.col("I1") > 45, "any_high")


def sum_all_null_group(spark, sf):
    d = labelled_documents(spark, sf)
    return d.groupBy("source", "lang").agg(
        agg_sum0("quality").alias("sum_quality"), F.count("quality").alias("answered")
    )


def distinct_values(spark, sf):
    return G.distinct_values(table(spark, sf, "part"), ["p_brand", "p_type"])


def quantiles_by_group(spark, sf):
    q = exact_quantiles(
        table(spark, sf, "lineitem"), "l_extendedprice", [0.01, 0.25, 0.5, 0.75, 0.99], ["l_returnflag"], overall=True
    )
    return round_cols(q, 4, "q1", "q2", "q3", "q4", "q5")


def quantiles_of_codes(spark, sf):
    q = exact_quantiles(table(spark, sf, "lineitem"), "l_quantity", [0.25, 0.5, 0.75], ["l_linenumber"])
    return round_cols(q, 4, "q1", "q2", "q3")


QUERIES = {
    "counts_overall_and_group": (
        counts_overall_and_group,
        f"""WITH p AS (SELECT CASE WHEN r_name <> 'ASIA' THEN r_name END AS region, c_acctbal FROM ({PARTICIPANTS}))
SELECT region, CAST(grouping(region) AS INTEGER) AS is_overall, count(*) AS n, {round_mean_sql("avg(c_acctbal)")} AS mean,
  min(c_acctbal) AS low, max(c_acctbal) AS high FROM p GROUP BY GROUPING SETS ((region), ())""",
    ),
    "share_of_group": (
        share_of_group,
        """SELECT *, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY o_orderstatus) AS DOUBLE) AS share
  FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)""",
    ),
    "group_max": (
        group_max,
        """SELECT c_custkey, c_nationkey, c_acctbal, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS best
  FROM customer""",
    ),
    "frequency_without_null": (
        frequency_without_null,
        "SELECT lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL",
    ),
    "crosstab_zero_cells": (
        crosstab_zero_cells,
        """SELECT r.row, c.col, count(d.lang) AS n FROM (VALUES ('en'), ('de'), ('fr'), ('es'), ('xx')) r(row)
  CROSS JOIN (VALUES ('0'), ('1')) c(col)
  LEFT JOIN (SELECT * FROM documents JOIN labels USING (doc_id)) d ON d.lang = r.row AND d.quality::VARCHAR = c.col
  GROUP BY ALL""",
    ),
    "conditional_counts": (
        conditional_counts,
        """SELECT lang, count(*) AS n_rows, count(quality) AS n_labelled, count(*) FILTER (WHERE quality = 1) AS n_good,
  count(*) FILTER (WHERE length(text) > 1000) AS n_long,
  count(*) FILTER (WHERE regexp_matches(text, '[0-9]{4}')) AS n_digits
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""",
    ),
    "footnote_counts": (
        footnote_counts,
        """SELECT count(*) AS n_rows, count(quality) AS n_known, count(*) FILTER (WHERE toxic = 1) AS n_toxic
  FROM documents LEFT JOIN labels USING (doc_id)""",
    ),
    "any_true_per_key": (
        any_true_per_key,
        f"""SELECT o_custkey, CASE WHEN bool_or(I1 > 45) THEN 1 WHEN count(*) > count(I1) THEN NULL ELSE 0 END AS any_high
  FROM ({BATTERY}) JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey""",
    ),
    "sum_all_null_group": (
        sum_all_null_group,
        """SELECT source, lang, CAST(coalesce(sum(quality), 0) AS BIGINT) AS sum_quality, count(quality) AS answered
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang""",
    ),
    "distinct_values": (distinct_values, "SELECT DISTINCT p_brand, p_type FROM part"),
    "quantiles_by_group": (
        quantiles_by_group,
        "WITH q AS (SELECT l_returnflag, 0 AS is_overall, l_extendedprice AS v FROM lineitem "
        "UNION ALL SELECT NULL, 1, l_extendedprice FROM lineitem) "
        "SELECT l_returnflag, is_overall, count(*) AS n, "
        + ", ".join(
            f"round(quantile_cont(v, {p}), 4) AS q{i}" for i, p in enumerate((0.01, 0.25, 0.5, 0.75, 0.99), 1)
        )
        + " FROM q GROUP BY l_returnflag, is_overall",
    ),
    "quantiles_of_codes": (
        quantiles_of_codes,
        "SELECT l_linenumber, count(*) AS n, "
        + ", ".join(f"round(quantile_cont(l_quantity, {p}), 4) AS q{i}" for i, p in enumerate((0.25, 0.5, 0.75), 1))
        + " FROM lineitem GROUP BY l_linenumber",
    ),
}
