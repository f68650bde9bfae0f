"""Survey-shaped frames that Spark derives from the driver tables.

One baseline row per customer, a follow-up for nine in eleven, labs and visits from
orders. Answers are arithmetic on the customer key, so the same frame can be
written in SQL; sentinel codes, missing answers and all three questionnaire
versions occur. The same definitions yield the Spark frame and its SQL.
"""

from __future__ import annotations

from string import ascii_uppercase as LETTERS

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyst.operators.columns import numbered
from panelyst.plans import catalog as K
from panelyst.queries.base import table

_BOX = [0, 1, 0]
_SPARSE_BOX = [0, 0, 1, 0, 0]
_OFTEN = [1, 2, 1, 3, 4, 5, 6, 1, 8, 9]


def _scale_codes(low: int, high: int, *extra) -> list:
    return [*range(low, high + 1), *extra, None]


BASELINE: dict[str, list] = {
    "surveylanguage": ["English", "English", "Spanish"],
    "LATINO": [0, 1, 0, 8, 0],
    "RACE": [1, 2, 8, 1],
    "RACEC": [0, 0, 1, 0, None],
    "RACEE": [1, 0, 1],
    "GENDER": [1, 1, 2, 3, 4, 5, 6, 8, None],
    "ORIENT": [1, 2, 3, 4, 5, 7, 8],
    "GRADE": [1, 2, 3, 4, 5, 6, 7, 8, None],
    "STAY7D": [1, 1, 1, *range(2, 13), 98],
    "BORNHIV": [0, 1],
    "DIAGHIV": [2010, 2012, 2015, 2099, None],
    "SCREEN5": [1, 2, 2, 7, 8],
    "INSURE": [1, 2, 97, 98, 99, 3, 4, 5],
    **dict.fromkeys(K.lettered("INSURE", "ABCDEFG"), [0, 0, 0, 1, 0]),
    "CARED6": [0, 1, 3, 998, 999, None, 2],
    "CAREHV06": [0, 1, 2, 4],
    "CARELHIV": [1, 1, 0, 8, 1],
    "ARTNOW": [0, 1, 1, 1, 9],
    "ARTADHR": [1, 2, 3, 4, 5, 6, 8, 9, None],
    "INJECTL": [0, 0, 0, 1, 8],
    "DISC": [*range(1, 11), 98, None],
    **dict.fromkeys(K.lettered("DISC", "ABCDEFGHI"), _SPARSE_BOX),
    "DRUG1L": [1, 98, 2],
    "DRUG2L": [3, 98],
    **dict.fromkeys(K.lettered("DRUG1L", LETTERS[:13]), _SPARSE_BOX),
    **dict.fromkeys(K.lettered("DRUG2L", LETTERS[:11]), [0, 0, 0, 1, 0, 0, 0, None, 0, 0, 0]),
    **dict.fromkeys(numbered("SOCIALS", range(1, 4)), _scale_codes(0, 10, 98)),
    **dict.fromkeys(numbered("STIGMA", range(1, 11)), _scale_codes(0, 4, 8)),
    **dict.fromkeys(numbered("HE", range(1, 11), 2), _scale_codes(1, 4, 7, 8, 9)),
    **dict.fromkeys(numbered("CARE", range(1, 11), 2), _scale_codes(1, 5, 8, 9)),
    **dict.fromkeys(numbered("MENTALH", range(1, 5)), _scale_codes(1, 6, 8)),
    **dict.fromkeys(numbered("MTUEX", range(1, 5)), _scale_codes(0, 9, 98)),
    **dict.fromkeys(numbered("MTUSPX", range(1, 13), 2), _scale_codes(0, 9, 98)),
    **dict.fromkeys(numbered("MTUIX", range(1, 7)), _scale_codes(0, 9, 98)),
    **dict.fromkeys(numbered("MTUSNX", range(1, 13), 2), _scale_codes(0, 9, 98, 99)),
    **dict.fromkeys(numbered("MTUAX", range(1, 15), 2), _scale_codes(0, 5, 8)),
}
FOLLOWUP: dict[str, list] = {
    "S56_1": [*[0] * 6, *[1] * 6, None],
    **dict.fromkeys(K.lettered("S56_1", "ABCDEFG"), [0, 1, 0, 1, 0, 1, 0, 0, 0, 9]),
    "S56_2S": [None, "tablet", None, "phone.....", None, "radio", None, None, "a....b"],
    "S56_3": [1, 2, 3, 4, 5, 6, 8],
    **dict.fromkeys(("S56_4", "S56_7", "S56_13", "S56_16", "S56_21"), _OFTEN),
    "S56_11": [0, 0, 0, 2, 3, 3, 4, *range(1, 12), 98, 99],
    "S56_20": [*range(1, 13), 98, 99],
    "S56_23": [1, 1, 2, 3, 4, 5, 6, 7, 8, None],
    **dict.fromkeys(
        [q.variable for q in K.COMM_QUESTIONS if not q.variable.startswith("S56_12")] + K.lettered("S56_12", "MNOPQ"),
        [0, 1, 0, 0, 1, 0, 8],
    ),
    **dict.fromkeys(K.SEARCH_ITEMS, [0, 0, 1, 0, 0, None, 0]),
    "S56_24": [0, 1, 2, 3],
    **dict.fromkeys(K.lettered("S56_25", LETTERS[:12]), [0, 0, 1, 0, 0, 0, 9]),
    **dict.fromkeys(K.lettered("S56_26", LETTERS[:14]), [0, 0, 1, 0, 0, 0, 9]),
    "S56_25S": [None, "NONE", None, "weather"],
    "S56_26S": [None, "HIV news", "NOTHING", None, None],
}
# Items whose presence depends on the questionnaire version, key % 3 = 0, 1, 2.
VERSIONED: dict[str, tuple[list, tuple[int, ...]]] = {
    **dict.fromkeys(K.lettered("S56_24", K.RETIRED), (_BOX, (0,))),
    **dict.fromkeys(K.lettered("S56_24X", K.RETIRED), (_BOX, (1, 2))),
    "S56_24U": ([0, 1], (2,)),
    "S56_24X": ([0, 1, 2], (2,)),
    "S56_24XV": ([0, 1, 9], (2,)),
}
SHEETS: dict[str, list] = {
    "GENDERRECODE": [None] * 20 + ["Other gender", "Trans-identified"],
    "RACERECODE": [None] * 9 + ["Latino", "Asian"],
    "ORIENTRECODE": [None] * 20 + ["Bisexual"],
    "STAYRECODE": [None] * 15 + ["Unstable housing"],
    "INSURERECODE": [None, None, "Insured"],
    "DISCRECODE": [None] * 7 + ["Partner, Family", "Other"],
    "DRUGRECODE": [None] * 7 + ["Alcohol", "Marijuana, Other"],
    "outcome_SSex_RECODE": [None, None, None, 1],
    "outcome_SGen_RECODE": [None] * 12 + [1],
}

# Customers whose key has one of these remainders by 11 have no follow-up.
_LOST = (0, 1)
_ORDER = {c: i for i, c in enumerate([*BASELINE, *FOLLOWUP, *VERSIONED, *SHEETS])}


def _spread(name: str) -> tuple[int, int, int]:
    i = _ORDER[name]
    return 2 * i + 3, i + 5, i


def _position(name: str, codes: list) -> str:
    a, b, c = _spread(name)
    return f"(k * {a} + (k {{div}} 7) * {b} + {c}) % {len(codes)} + 1"


def _literal(x) -> str:
    return "NULL" if x is None else repr(x)


def answer(name: str, codes: list) -> str:
    """Spark SQL expression of one answer."""
    at = _position(name, codes).format(div="div")
    return f"element_at(array({', '.join(map(_literal, codes))}), CAST({at} AS INT)) AS `{name}`"


def answer_sql(name: str, codes: list) -> str:
    kind = "VARCHAR" if any(isinstance(x, str) for x in codes) else "INTEGER"
    at = _position(name, codes).format(div="//")
    return f"list_extract([{', '.join(map(_literal, codes))}]::{kind}[], CAST({at} AS INTEGER))"


# --- Spark frames -------------------------------------------------------------------
def _people(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    site = (k % 10 + 1).cast("int")
    text = k.cast("string")
    pid = F.when((site == 10) & (F.length(text) < 4), F.lpad(text, 4, "0")).otherwise(text)
    return table(spark, sf, "customer").select(k.alias("k"), site.alias("SITE1"), pid.alias("PID"), "c_acctbal")


def baseline(spark: SparkSession, sf: str) -> DataFrame:
    p = _people(spark, sf).where("k % 17 <> 0")
    today = "date_add(DATE'2017-01-01', CAST(k * 37 % 400 AS INT))"
    born = "date_add(DATE'1983-01-01', CAST(k * 911 % 6500 AS INT))"
    return p.selectExpr(
        "SITE1",
        "PID",
        f"CAST({today} AS STRING) AS TODAY",
        f"CAST({born} AS STRING) AS DOB",
        f"year({born}) AS DOBY",
        f"CASE WHEN k % 50 = 9 THEN -1 ELSE CAST(floor(datediff({today}, {born}) / 365.25) AS INT) END AS AGE",
        "CASE WHEN k % 19 = 0 THEN 99998 WHEN k % 23 = 0 THEN NULL WHEN c_acctbal < 1000 THEN 0 "
        "ELSE CAST(floor(c_acctbal) AS INT) END AS MONEY",
        "CAST(NULL AS INT) AS AGE_BLANK",
        *[answer(c, codes) for c, codes in BASELINE.items()],
    )


def followup(spark: SparkSession, sf: str) -> DataFrame:
    p = _people(spark, sf).where(f"k % 11 NOT IN {_LOST}")
    versioned = []
    for c, (codes, where) in VERSIONED.items():
        value = answer(c, codes).rsplit(" AS ", 1)[0]
        versioned.append(f"CASE WHEN k % 3 IN ({', '.join(map(str, where))}) THEN {value} END AS `{c}`")
    return p.selectExpr("SITE1", "PID", *[answer(c, codes) for c, codes in FOLLOWUP.items()], *versioned)


def _chart_ids(df: DataFrame, key: str) -> DataFrame:
    """Chart-side site code and local id: prefixed in one site, unpadded in another."""
    k = F.col(key)
    code = F.element_at(F.array(*[F.lit(c) for c in K.SITE_CODES.values()]), (k % 10 + 1).cast("int"))
    local = F.when(k % 10 == 1, F.concat(F.lit("F"), k.cast("string"))).otherwise(k.cast("string"))
    return df.withColumns({"SiteID": code, "SiteSpecificID": local})


def history(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_custkey % 3 <> 0")
    return _chart_ids(c, "c_custkey").select(
        "SiteID", "SiteSpecificID", (F.lit(1985) + F.col("c_custkey") % 30).cast("int").alias("HIVDiagnosisYear")
    )


def _day_number(days: Column) -> Column:
    """Order dates moved from 1995-2001 to 2013-2019, as days since 1960."""
    return F.datediff(F.date_add(days.cast("date"), 6575), F.lit("1960-01-01").cast("date"))


def labs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return _chart_ids(o, "o_custkey").select(
        "SiteID",
        "SiteSpecificID",
        _day_number(F.col("o_orderdate")).alias("ServiceDate"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("ViralSupp"),
    ).where("SiteSpecificID NOT LIKE '%7'")


def ambulatory(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").where("o_custkey % 8 <> 3")
    return _chart_ids(o, "o_custkey").select(
        "SiteID", "SiteSpecificID", _day_number(F.col("o_orderdate")).alias("ServiceDate")
    )


def crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_custkey % 10 = 1 AND c_custkey % 30 <> 11")
    return _chart_ids(c, "c_custkey").select("SiteSpecificID", F.col("c_custkey").cast("string").alias("PID"))


def sheets(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """One adjudication sheet, keyed by site code; rows only where something was decided."""
    p = _people(spark, sf)
    code = F.element_at(F.array(*[F.lit(c) for c in K.SITE_CODES.values()]), F.col("SITE1"))
    out = p.withColumn("SITE1", code).selectExpr("SITE1", "PID", *[answer(c, x) for c, x in SHEETS.items()])
    return {"OTHER": out.where(F.coalesce(*[F.col(c).cast("string") for c in SHEETS]).isNotNull())}


# --- the same frames in SQL -----------------------------------------------------------
_PEOPLE_SQL = """SELECT c_custkey AS k, CAST(c_custkey % 10 + 1 AS INTEGER) AS site_no,
  CASE WHEN c_custkey % 10 = 9 AND length(c_custkey::VARCHAR) < 4 THEN lpad(c_custkey::VARCHAR, 4, '0')
  ELSE c_custkey::VARCHAR END AS PID, c_acctbal FROM customer"""
_TODAY_SQL = "(DATE '2017-01-01' + CAST(k * 37 % 400 AS INTEGER))"
_BORN_SQL = "(DATE '1983-01-01' + CAST(k * 911 % 6500 AS INTEGER))"
_YEARS_SQL = f"CAST(floor(date_diff('day', {_BORN_SQL}, {_TODAY_SQL}) / 365.25) AS INTEGER)"
SITE_SQL = "['" + "', '".join(K.SITE_CODES.values()) + "']"

BASELINE_SQL = f"""SELECT k, list_extract({SITE_SQL}, site_no) AS SITE1, PID, {_TODAY_SQL} AS TODAY_D,
  {_YEARS_SQL} AS AGE_RC, CAST(year({_BORN_SQL}) AS INTEGER) AS DOBY,
  CASE WHEN PID = '0020' AND site_no = 10 AND k % 50 = 9 THEN 19 WHEN k % 50 = 9 THEN -1 ELSE {_YEARS_SQL} END AS AGE,
  CASE WHEN k % 19 = 0 THEN 99998 WHEN k % 23 = 0 THEN NULL WHEN c_acctbal < 1000 THEN 0
    ELSE CAST(floor(c_acctbal) AS INTEGER) END AS MONEY,
  {", ".join(f'{answer_sql(c, codes)} AS "{c}"' for c, codes in BASELINE.items())}
FROM ({_PEOPLE_SQL}) WHERE k % 17 <> 0 AND {answer_sql("MTUEX1", BASELINE["MTUEX1"])} IS NOT NULL"""

FOLLOWUP_SQL = f"""SELECT k, list_extract({SITE_SQL}, site_no) AS SITE1, PID,
  {", ".join(f'{answer_sql(c, codes)} AS "{c}"' for c, codes in FOLLOWUP.items())},
  {", ".join(
    f'CASE WHEN k % 3 IN ({", ".join(str(w) for w in where)}) THEN {answer_sql(c, codes)} END AS "{c}"'
    for c, (codes, where) in VERSIONED.items()
  )}
FROM ({_PEOPLE_SQL}) WHERE k % 11 NOT IN {_LOST} AND {answer_sql("S56_1", FOLLOWUP["S56_1"])} IS NOT NULL
  AND NOT coalesce(contains({answer_sql("S56_2S", FOLLOWUP["S56_2S"])}, '.....'), false)"""

# Rows of the re-keyed site that the cross-walk lacks are linked to nobody.
_KNOWN = "NOT (k % 10 = 1 AND k % 30 = 11)"
CHART_DAY_SQL = "(o_orderdate::DATE + 6575)"
HISTORY_SQL = f"""SELECT c_custkey AS k, CAST(1985 + c_custkey % 30 AS INTEGER) AS year FROM customer
  WHERE c_custkey % 3 <> 0 AND {_KNOWN.replace("k %", "c_custkey %")}"""
LABS_SQL = f"""SELECT o_custkey AS k, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END AS supp, {CHART_DAY_SQL} AS day
  FROM orders WHERE o_custkey % 10 <> 7 AND {_KNOWN.replace("k %", "o_custkey %")}"""
VISITS_SQL = f"""SELECT o_custkey AS k, {CHART_DAY_SQL} AS day FROM orders
  WHERE o_custkey % 8 <> 3 AND {_KNOWN.replace("k %", "o_custkey %")}"""
SHEET_SQL = f"""SELECT k, {", ".join(f'{answer_sql(c, codes)} AS "{c}"' for c, codes in SHEETS.items())}
  FROM (SELECT c_custkey AS k FROM customer)"""
