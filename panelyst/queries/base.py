"""Tables in their survey roles, shared by the registered queries.

A participant is a customer, a site a nation or region, a visit an order, and
an item battery the lines 1 to 7 of an order (incomplete by nature).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def participants(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with their nation and region names."""
    c, n, r = (table(spark, sf, x) for x in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)


PARTICIPANTS = """
  SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey"""


def battery(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order, items I1..I7 = largest quantity on lines 1..7, else NULL."""
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_orderkey").agg(
        *[
            F.max(F.when(F.col("l_linenumber") == i, F.col("l_quantity"))).cast("int").alias(f"I{i}")
            for i in range(1, 8)
        ]
    )


BATTERY = (
    "SELECT l_orderkey, "
    + ", ".join(
        f"CAST(max(CASE WHEN l_linenumber = {i} THEN l_quantity END) AS INTEGER) AS I{i}" for i in range(1, 8)
    )
    + " FROM lineitem GROUP BY l_orderkey"
)


def returned_items(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order: item k is 1 if a line k was returned, 0 if there is one, else NULL."""
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_orderkey").agg(
        *[
            F.max(F.when(F.col("l_linenumber") == i, (F.col("l_returnflag") == "R").cast("int"))).alias(f"R{i}")
            for i in range(1, 8)
        ]
    )


RETURNED = (
    "SELECT l_orderkey, "
    + ", ".join(
        f"max(CASE WHEN l_linenumber = {i} THEN CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END END) AS R{i}"
        for i in range(1, 8)
    )
    + " FROM lineitem GROUP BY l_orderkey"
)


def labelled_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the quality flags some of them have."""
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")


def round_cols(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# Means of cents can end exactly on a rounding edge, where the last bit of a floating sum would decide. As
# decimals of nine places such values are exact, and both sides round them the same way.
def round_means(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("decimal(38,9)"), 4).cast("double") for c in cols})


def round_mean_sql(expr: str) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(38,9)), 4) AS DOUBLE)"
