"""Cleaning, column selection and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyst.functions import nulls as N
from panelyst.functions import scalars as S
from panelyst.operators import clean as C
from panelyst.operators import columns as K
from panelyst.operators.codebook import analysis_extract
from panelyst.queries.base import BATTERY, battery, labelled_documents, table


def token_to_null(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("....."), "p_name")).otherwise(F.col("p_name")).alias("p_name"),
        F.when(F.col("p_size") % 5 == 0, F.concat("p_type", F.lit("...."))).otherwise(F.col("p_type")).alias("p_type"),
    )
    return C.token_to_null(p)


def token_in_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return C.token_to_null(d, r"\d{3}", ["text"]).select(
        "doc_id", "lang", F.length("text").alias("kept_chars")
    )


def na_strings(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, "NA")
        .when(F.col("c_acctbal") > 9000, "")
        .otherwise(F.col("c_mktsegment"))
        .alias("segment"),
    )
    return C.na_strings(c)


def sentinel_to_null(spark, sf):
    return C.sentinel_to_null(table(spark, sf, "part").select("p_partkey", "p_size"), ["p_size"], 40, "_RC")


def remap_then_scrub(spark, sf):
    return C.remap_then_scrub(
        table(spark, sf, "part").select("p_partkey", "p_size"), ["p_size"], {50: 0, 49: 1}, 40, "_RC"
    )


def correct_where(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    where = (F.col("c_nationkey") == 10) & (F.col("c_acctbal") < 0) & (F.col("c_custkey") % 2 == 0)
    return C.correct_where(c, "c_acctbal", 19.0, where)


def zero_fill(spark, sf):
    return C.zero_fill(labelled_documents(spark, sf), ["quality", "toxic"]).select("doc_id", "quality", "toxic")


def pad_subgroup(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return C.pad_subgroup(c, "c_custkey", F.col("c_mktsegment") == "BUILDING", 3)


def override_from_text(spark, sf):
    d = labelled_documents(spark, sf).select("doc_id", "text", "quality")
    return C.override_from_text(d, "quality", "text", "license|License", 0).drop("text")


def reverse_code(spark, sf):
    b = battery(spark, sf)
    return b.select("l_orderkey", C.reverse_code("I3", 1, 50).alias("I3_RC"))


def split_valid(spark, sf):
    valid, rejects = C.split_valid(
        labelled_documents(spark, sf).select("doc_id", "lang", "quality", "toxic"),
        F.col("quality").isNull() | (F.col("toxic") == 1),
    )
    return valid.withColumn("part", F.lit("valid")).unionByName(rejects.withColumn("part", F.lit("reject")))


def rejects_not_in_valid(spark, sf):
    """Rejected order lines whose order also has a valid line."""
    from panelyst.operators.link import key_overlap

    valid, rejects = C.split_valid(
        table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), F.col("l_returnflag") == "R"
    )
    return key_overlap(rejects, valid, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("rejected"))


def binary_rows(spark, sf):
    return C.binary_rows(labelled_documents(spark, sf), ["quality", "toxic"]).select("doc_id", "quality", "toxic")


def answered_rows(spark, sf):
    b = battery(spark, sf)
    items = ["I1", "I2", "I3"]
    return C.answered_rows(b, items).select("l_orderkey", *items)


def complete_rows(spark, sf):
    return C.complete_rows(battery(spark, sf), ["I1", "I2", "I7"]).select("l_orderkey", "I1", "I2", "I7")


def without_levels(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "5-LOW", "Skipped")
        .when(F.col("o_orderstatus") == "P", F.lit(None))
        .otherwise(F.col("o_orderpriority"))
        .alias("answer"),
    )
    return C.without_levels(o, "answer")


def null_predicates(spark, sf):
    b = battery(spark, sf)
    items = ["I1", "I2", "I3"]
    return b.select(
        "l_orderkey",
        N.null_count(items).alias("n_missing"),
        N.row_sum(items).alias("sum_skip"),
        N.row_sum(items, skip_null=False).alias("sum_null"),
        N.any_equal(items, 7).cast("int").alias("any_seven"),
        N.if_else(F.col("I1") > 25, F.lit(1), F.lit(0)).alias("high"),
        N.is_in("I1", [1, 2, 3]).cast("int").alias("low"),
        S.positive("I2").alias("is_one"),
        S.positive_in_range("I2").alias("small"),
    )


def null_profile(spark, sf):
    d = labelled_documents(spark, sf).withColumn("blank", F.lit(None).cast("string"))
    return K.null_profile(d, ["doc_id", "quality", "toxic", "blank"])


def drop_all_null(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_size") > 1000, F.col("p_size")).alias("never"),
        F.when(F.col("p_size") > 49, F.col("p_size")).alias("rare"),
    )
    return K.drop_all_null(p)


def drop_all_zero(spark, sf):
    d = table(spark, sf, "labels").withColumns(
        {
            "zero": F.lit(0),
            "zero_or_null": F.when(F.col("quality") == 1, F.lit(0)),
        }
    )
    return K.drop_all_zero(d)


def column_selection(spark, sf):
    c = table(spark, sf, "customer")
    names = [
        *K.starting_with(c, "C_N"),
        *K.matching(c, r"bal$"),
        *K.existing(c, ["c_mktsegment", "c_unknown"]),
    ]
    return K.rename(K.key_first(c.select(*names, "c_custkey"), "c_custkey"), {"c_acctbal": "balance"})


def drop_between(spark, sf):
    """All items but a range of them, which is also taken on its own for a count of answers."""
    b = battery(spark, sf)
    inner = [F.col(c).isNotNull().cast("int") for c in K.between(b, "I2", "I4")]
    return K.drop_between(b.withColumn("inner", sum(inner, F.lit(0))), "I2", "I4")


def map_columns(spark, sf):
    b = battery(spark, sf)
    return K.map_columns(b.select("l_orderkey", "I1", "I2"), ["I1", "I2"], lambda c: c + 1, "_next")


def summarise_columns(spark, sf):
    b = battery(spark, sf)
    return K.to_long(
        K.summarise_columns(b, K.between(b, "I1", "I7"), lambda c: F.sum(c)).withColumn("k", F.lit(1)),
        ["k"],
        K.numbered("I", range(1, 8)),
        "item",
        "total",
    ).drop("k")


def long_to_wide(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return K.to_wide(o, ["o_orderpriority"], "o_orderstatus", "n", ["F", "O", "P"])


def keep_shared(spark, sf):
    return K.keep_shared(table(spark, sf, "documents"), table(spark, sf, "labels").withColumn("lang", F.lit("")))


def analysis_extract_rows(spark, sf):
    b = battery(spark, sf).join(
        table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    ).withColumns({"never": F.lit(0), "urgent": (F.col("o_orderpriority") == "1-URGENT").cast("int")})
    return analysis_extract(
        b,
        ["l_orderkey", "o_totalprice", "never", "urgent", "I1", "I2"],
        F.col("o_orderstatus") == "F",
        F.col("o_totalprice") >= 18000,
        ["I1", "I2"],
    )


QUERIES = {
    "token_to_null": (
        token_to_null,
        """SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_name END AS p_name,
  CASE WHEN p_size % 5 = 0 THEN p_type || '....' ELSE p_type END AS p_type FROM part""",
    ),
    "token_in_text": (
        token_in_text,
        """SELECT doc_id, lang, CASE WHEN NOT regexp_matches(text, '[0-9]{3}')
  THEN CAST(length(text) AS INTEGER) END AS kept_chars FROM documents""",
    ),
    "na_strings": (
        na_strings,
        """SELECT c_custkey, CASE WHEN c_acctbal >= 0 AND c_acctbal <= 9000 THEN c_mktsegment END AS segment
  FROM customer""",
    ),
    "sentinel_to_null": (
        sentinel_to_null,
        'SELECT p_partkey, p_size, CASE WHEN p_size <= 40 THEN p_size END AS "p_size_RC" FROM part',
    ),
    "remap_then_scrub": (
        remap_then_scrub,
        """SELECT p_partkey, p_size, CASE WHEN p_size = 50 THEN 0 WHEN p_size = 49 THEN 1
  WHEN p_size > 40 THEN NULL ELSE p_size END AS "p_size_RC" FROM part""",
    ),
    "correct_where": (
        correct_where,
        """SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey = 10 AND c_acctbal < 0 AND c_custkey % 2 = 0
  THEN 19.0::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer""",
    ),
    "zero_fill": (
        zero_fill,
        """SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic
  FROM documents LEFT JOIN labels USING (doc_id)""",
    ),
    "pad_subgroup": (
        pad_subgroup,
        """SELECT CASE WHEN c_mktsegment = 'BUILDING' AND length(c_custkey::VARCHAR) < 3
  THEN lpad(c_custkey::VARCHAR, 3, '0') ELSE c_custkey::VARCHAR END AS c_custkey, c_mktsegment FROM customer""",
    ),
    "override_from_text": (
        override_from_text,
        """SELECT doc_id, CASE WHEN regexp_matches(text, 'license|License') THEN 0 ELSE quality END AS quality
  FROM documents LEFT JOIN labels USING (doc_id)""",
    ),
    "reverse_code": (reverse_code, f'SELECT l_orderkey, 51 - I3 AS "I3_RC" FROM ({BATTERY})'),
    "split_valid": (
        split_valid,
        """SELECT doc_id, lang, quality, toxic, CASE WHEN quality IS NULL OR toxic = 1 THEN 'reject'
  ELSE 'valid' END AS part FROM documents LEFT JOIN labels USING (doc_id)""",
    ),
    "rejects_not_in_valid": (rejects_not_in_valid, """SELECT l_orderkey, count(*) AS rejected FROM lineitem WHERE l_returnflag = 'R'
  AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R') GROUP BY l_orderkey"""),
    "drop_between": (
        drop_between,
        f"""SELECT l_orderkey, I1, I5, I6, I7, CAST(I2 IS NOT NULL AS INTEGER) + CAST(I3 IS NOT NULL AS INTEGER)
  + CAST(I4 IS NOT NULL AS INTEGER) AS "inner" FROM ({BATTERY})""",
    ),
    "binary_rows": (
        binary_rows,
        """SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id)
  WHERE quality IN (0, 1) AND toxic IN (0, 1)""",
    ),
    "answered_rows": (
        answered_rows,
        f"SELECT l_orderkey, I1, I2, I3 FROM ({BATTERY}) WHERE coalesce(I1, I2, I3) IS NOT NULL",
    ),
    "complete_rows": (
        complete_rows,
        f"""SELECT l_orderkey, I1, I2, I7 FROM ({BATTERY})
  WHERE I1 IS NOT NULL AND I2 IS NOT NULL AND I7 IS NOT NULL""",
    ),
    "without_levels": (
        without_levels,
        """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS answer
  FROM orders WHERE o_orderpriority <> '5-LOW'""",
    ),
    "null_predicates": (
        null_predicates,
        f"""SELECT l_orderkey,
  CAST((I1 IS NULL)::INT + (I2 IS NULL)::INT + (I3 IS NULL)::INT AS INTEGER) AS n_missing,
  coalesce(I1, 0) + coalesce(I2, 0) + coalesce(I3, 0) AS sum_skip, I1 + I2 + I3 AS sum_null,
  CASE WHEN I1 + I2 + I3 IS NOT NULL THEN CAST(I1 = 7 OR I2 = 7 OR I3 = 7 AS INTEGER) END AS any_seven,
  CAST(I1 > 25 AS INTEGER) AS high, CAST(coalesce(I1 IN (1, 2, 3), false) AS INTEGER) AS low,
  CAST(I2 = 1 AS INTEGER) AS is_one, CAST(I2 > 0 AND I2 < 10 AS INTEGER) AS small FROM ({BATTERY})""",
    ),
    "null_profile": (
        null_profile,
        """WITH d AS (SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'doc_id' AS variable, count(*) - count(doc_id) AS n_null, count(*) AS n_rows FROM d
UNION ALL SELECT 'quality', count(*) - count(quality), count(*) FROM d
UNION ALL SELECT 'toxic', count(*) - count(toxic), count(*) FROM d
UNION ALL SELECT 'blank', count(*), count(*) FROM d""",
    ),
    "drop_all_null": (
        drop_all_null,
        "SELECT p_partkey, CASE WHEN p_size > 49 THEN p_size END AS rare FROM part",
    ),
    "drop_all_zero": (
        drop_all_zero,
        "SELECT doc_id, quality, toxic, CASE WHEN quality = 1 THEN 0 END AS zero_or_null FROM labels",
    ),
    "column_selection": (
        column_selection,
        "SELECT c_custkey, c_name, c_nationkey, c_acctbal AS balance, c_mktsegment FROM customer",
    ),
    "map_columns": (
        map_columns,
        f"SELECT l_orderkey, I1, I2, I1 + 1 AS I1_next, I2 + 1 AS I2_next FROM ({BATTERY})",
    ),
    "summarise_columns": (
        summarise_columns,
        " UNION ALL ".join(
            f"SELECT 'I{i}' AS item, CAST(sum(I{i}) AS BIGINT) AS total FROM ({BATTERY})" for i in range(1, 8)
        ),
    ),
    "long_to_wide": (
        long_to_wide,
        """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F",
  count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P"
  FROM orders GROUP BY o_orderpriority""",
    ),
    "keep_shared": (keep_shared, "SELECT doc_id, lang FROM documents"),
    "analysis_extract": (
        analysis_extract_rows,
        f"""SELECT l_orderkey, o_totalprice, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS urgent, I1, I2
  FROM ({BATTERY}) JOIN orders ON l_orderkey = o_orderkey
  WHERE o_orderstatus = 'F' AND o_totalprice >= 18000 AND I1 IS NOT NULL AND I2 IS NOT NULL""",
    ),
}
