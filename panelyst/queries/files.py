"""File round trips, lookups and codebooks.

The files are written by Spark from the given tables into the shared folder
and read back by the library's readers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyst.operators import codebook as B
from panelyst.operators import tables as T
from panelyst.operators.link import attach, rekey_subgroup
from panelyst.queries.base import PARTICIPANTS, labelled_documents, participants, table
from panelyst.queries.tables import factor_sql
from panelyst.sources import readers, sinks


def csv_na_scan(spark, sf):
    folder = sinks.shared_folder(spark)
    c = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, "NA").when(F.col("c_acctbal") > 9000, "").otherwise(F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_nationkey") == 7, "NA").otherwise(F.col("c_nationkey").cast("string")).alias("nation"),
    )
    sinks.export_csv(c, f"{folder}/survey")
    return readers.read_csv(spark, f"{folder}/survey", "c_custkey BIGINT, segment STRING, nation INT")


def _visit_sets(spark, sf):
    """Three file sets of one folder: visits of two groups of sites, in different column orders, and other data."""
    folder = sinks.shared_folder(spark)
    c = table(spark, sf, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("pid"), "c_nationkey", "c_acctbal"
    )
    sinks.export_csv(c.where("c_nationkey < 12"), f"{folder}/MCD_Visits")
    sinks.export_csv(c.where("c_nationkey >= 12").select("c_acctbal", "pid", "c_nationkey"), f"{folder}/NORTH_Visits")
    sinks.export_csv(c.withColumn("c_acctbal", -F.col("c_acctbal")), f"{folder}/MCD_Labs")
    return folder


def csv_text_ids(spark, sf):
    paths = readers.find_files(spark, _visit_sets(spark, sf), r"_Visits$")
    return readers.read_csv_inferred(spark, paths, text_cols=["pid"])


def csv_found_by_name(spark, sf):
    """The same sets with given types; the columns are asked for in a third order."""
    paths = readers.find_files(spark, _visit_sets(spark, sf), r"^(MCD|NORTH)_V")
    return readers.read_csv(spark, paths, "c_nationkey INT, c_acctbal DOUBLE, pid STRING")


def csv_free_text(spark, sf):
    """Free text with quotes, commas and line breaks, written and read back."""
    folder = sinks.shared_folder(spark)
    quoted = F.concat(F.lit('"quoted", '), F.col("text"), F.lit(' \\" '))
    d = table(spark, sf, "documents").select("lang", "doc_id", F.when(F.col("doc_id") % 2 == 0, quoted).otherwise(F.col("text")).alias("text"))
    sinks.export_csv(d, f"{folder}/texts")
    return readers.read_csv(spark, f"{folder}/texts", "doc_id BIGINT, text STRING", multiline=True)


def lookup_scan(spark, sf):
    """A headerless cross-walk sheet, used to re-key one site's participants."""
    folder = sinks.shared_folder(spark)
    s = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("P"), "s_suppkey"), "s_nationkey")
    s.write.csv(f"{folder}/pids")
    xwalk = readers.read_lookup(spark, f"{folder}/pids", ["local_id", "pid", "withdrawn"], drop=["withdrawn"])
    c = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("site"), F.col("c_custkey").cast("string").alias("local_id")
    )
    return rekey_subgroup(c, xwalk, F.col("site") == 3, "local_id", "pid", out="pid")


def lookup_sheets(spark, sf):
    """Two recode sheets from one folder, attached one after the other."""
    folder = sinks.shared_folder(spark)
    sinks.export_report({"NATIONS": table(spark, sf, "nation"), "REGIONS": table(spark, sf, "region")}, folder)
    sheets = readers.read_lookups(spark, folder, ["NATIONS", "REGIONS"])
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("n_nationkey"))
    out = attach(c, sheets["NATIONS"], ["n_nationkey"])
    out = out.withColumnRenamed("n_regionkey", "r_regionkey")
    return attach(out, sheets["REGIONS"], ["r_regionkey"]).select("c_custkey", "n_name", "r_name")


_LABELS = {"c_custkey": "Participant", "c_acctbal": "Account balance", "c_mktsegment": "Market segment"}


def labelled_scan(spark, sf):
    folder = sinks.shared_folder(spark)
    B.with_labels(table(spark, sf, "customer"), _LABELS).write.parquet(f"{folder}/labelled")
    df, labels = readers.read_labelled(spark, f"{folder}/labelled")
    filled = df.agg(*[F.count(c).alias(c) for c in df.columns])
    counts = filled.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("n")) for c in df.columns]))
    )
    return labels.join(counts, "variable")


def save_and_load(spark, sf):
    folder = sinks.shared_folder(spark)
    people = participants(spark, sf)
    sinks.save_tables(
        {
            "segments": T.one_factor_table(people, "r_name", "c_mktsegment", header="Segment"),
            "sizes": T.group_sizes(people, "r_name"),
        },
        folder,
    )
    back = sinks.load_tables(spark, folder, ["segments", "sizes"])
    return back["segments"].join(back["sizes"].where("is_overall = 0").select("grp", "heading"), "grp").select(
        "heading", "level", "n", "total"
    )


def export_report(spark, sf):
    folder = sinks.shared_folder(spark)
    t = T.one_factor_table(participants(spark, sf), "r_name", "c_mktsegment", header="Segment")
    sinks.export_report({"Table 1": t}, folder)
    return readers.read_csv(
        spark,
        f"{folder}/Table 1",
        "header STRING, level STRING, level_n BIGINT, grp STRING, is_overall INT, n BIGINT, total BIGINT, share DOUBLE",
    )


def stage_table(spark, sf):
    """A linked table written once to the shared folder and summarised from there."""
    staged = sinks.materialise(labelled_documents(spark, sf).select("lang", "source", "quality"))
    return staged.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled"))


_PROFILE_COLS = ["doc_id", "lang", "quality", "toxic", "n_chars"]


def codebook_profile(spark, sf):
    return B.profile(labelled_documents(spark, sf), _PROFILE_COLS, exact_distinct=True)


def codebook(spark, sf):
    labels = readers.literal_table(
        spark,
        [("quality", "Quality (0/1)"), ("lang", "Language"), ("gone", "Dropped before")],
        "variable string, label string",
    )
    book = B.codebook(labelled_documents(spark, sf), labels, _PROFILE_COLS)
    return book.select("variable", "label", "n_null", "is_binary")


def _profile_sql(c: str, kind: str, binary: bool) -> str:
    flag = f"CAST(count(*) FILTER (WHERE {c} IN (0, 1)) = count({c}) AND count({c}) > 0 AS INTEGER)" if binary else "0"
    return f"""SELECT '{c}' AS variable, '{kind}' AS type, count(*) AS n_rows, count(*) - count({c}) AS n_null,
  min({c})::VARCHAR AS min, max({c})::VARCHAR AS max, count(DISTINCT {c}) AS n_distinct, {flag} AS is_binary FROM d"""


_PROFILE = "WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) " + " UNION ALL ".join(
    _profile_sql(c, k, b)
    for c, k, b in (
        ("doc_id", "bigint", True),
        ("lang", "string", False),
        ("quality", "int", True),
        ("toxic", "int", True),
        ("n_chars", "bigint", True),
    )
)

QUERIES = {
    "csv_na_scan": (
        csv_na_scan,
        """SELECT c_custkey, CASE WHEN c_acctbal >= 0 AND c_acctbal <= 9000 THEN c_mktsegment END AS segment,
  CASE WHEN c_nationkey <> 7 THEN c_nationkey END AS nation FROM customer""",
    ),
    "csv_text_ids": (
        csv_text_ids,
        "SELECT lpad(c_custkey::VARCHAR, 8, '0') AS pid, c_nationkey, c_acctbal FROM customer",
    ),
    "csv_found_by_name": (
        csv_found_by_name,
        "SELECT c_nationkey, c_acctbal, lpad(c_custkey::VARCHAR, 8, '0') AS pid FROM customer",
    ),
    "csv_free_text": (
        csv_free_text,
        """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '"quoted", ' || text || ' \\" ' ELSE text END AS text FROM documents""",
    ),
    "lookup_scan": (
        lookup_scan,
        """SELECT c_nationkey AS site, CASE WHEN c_nationkey <> 3 THEN c_custkey::VARCHAR
  WHEN s_suppkey IS NOT NULL THEN 'P' || s_suppkey END AS pid
  FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""",
    ),
    "lookup_sheets": (lookup_sheets, f"SELECT c_custkey, n_name, r_name FROM ({PARTICIPANTS})"),
    "labelled_scan": (
        labelled_scan,
        """SELECT 'c_custkey' AS variable, 'Participant' AS description, count(c_custkey) AS n FROM customer
  UNION ALL SELECT 'c_name', NULL, count(c_name) FROM customer
  UNION ALL SELECT 'c_nationkey', NULL, count(c_nationkey) FROM customer
  UNION ALL SELECT 'c_acctbal', 'Account balance', count(c_acctbal) FROM customer
  UNION ALL SELECT 'c_mktsegment', 'Market segment', count(c_mktsegment) FROM customer""",
    ),
    "save_and_load": (
        save_and_load,
        f"""SELECT r_name || ' (N=' || total || ')' AS heading, c_mktsegment AS level, n, total FROM
  (SELECT r_name, c_mktsegment, count(*) AS n FROM ({PARTICIPANTS}) GROUP BY ALL)
  JOIN (SELECT r_name, count(*) AS total FROM ({PARTICIPANTS}) GROUP BY ALL) USING (r_name)""",
    ),
    "export_report": (
        export_report,
        factor_sql(f"SELECT r_name AS grp, c_mktsegment AS level FROM ({PARTICIPANTS})", "Segment"),
    ),
    "stage_table": (
        stage_table,
        """SELECT lang, count(*) AS n, count(quality) AS labelled FROM documents LEFT JOIN labels USING (doc_id)
  GROUP BY lang""",
    ),
    "codebook_profile": (codebook_profile, _PROFILE),
    "codebook": (
        codebook,
        f"""SELECT variable, CASE variable WHEN 'quality' THEN 'Quality (0/1)' WHEN 'lang' THEN 'Language' END AS label,
  n_null, is_binary FROM ({_PROFILE})""",
    ),
}
