"""The study's derivation and reports, on frames derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyst.plans import catalog as K
from panelyst.plans import derive as D
from panelyst.plans import reports as R
from panelyst.plans.needs import closure
from panelyst.queries import frames as X
from panelyst.queries.base import round_cols, round_means
from panelyst.queries.prevalence import categories_sql, items_sql
from panelyst.queries.tables import binary_sql, factor_sql, mean_sql, median_sql
from panelyst.queries.tests import chi2_p_sql, chi_square_sql, f_p_sql, logit_sql, residuals_sql
from panelyst.sources.sinks import materialise


# --- the pipeline ----------------------------------------------------------------------
def linked(spark: SparkSession, sf: str, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The linked table and the clean baseline; with ``names`` only what those are made from."""
    needed = None if names is None else closure(names)
    base, _ = D.clean_baseline(X.baseline(spark, sf), None if needed is None else {*needed, "TODAY"})
    follow, _ = D.clean_followup(X.followup(spark, sf))
    table = D.link_study(
        base,
        D.harmonise_followup(follow),
        X.history(spark, sf),
        X.labs(spark, sf),
        X.ambulatory(spark, sf),
        X.crosswalk(spark, sf),
        X.sheets(spark, sf),
        needed=needed,
    )
    return table, base


def study(spark: SparkSession, sf: str, names: list[str] | None = None) -> DataFrame:
    """The derived table with all variables, or with ``names`` and nothing they don't need."""
    table, base = linked(spark, sf, names)
    return D.derive(table, base, only=names)


def _report(name: str, build, often: bool = False):
    """A report on the variables it reads; they are written first where it reads them ``often``."""

    def run(spark, sf):
        rows = study(spark, sf, R.READS[name])
        return build(materialise(rows, name) if often else rows)

    return run


def study_harmonised(spark, sf):
    follow, _ = D.clean_followup(X.followup(spark, sf))
    return D.site_codes(D.harmonise_followup(follow)).select(
        *K.KEYS, "S56_24", "S56_24U", "S56_24X", "S56_24XV", *K.HARMONISED
    )


def study_linked(spark, sf):
    return linked(spark, sf)[0].select(
        *K.KEYS, "Set", "AGE", "HIVDiagnosisYear_MCD", "ViralSupp_MCD", "CAREHV06_MCD", *X.SHEETS, "S56_25A"
    )


def study_rejects(spark, sf):
    rejects = D.clean_followup(X.followup(spark, sf))[1]
    return D.site_codes(rejects).select(*K.KEYS, "S56_1", "S56_2S")


def study_orphans(spark, sf):
    from panelyst.operators.link import orphans

    base, _ = D.clean_baseline(X.baseline(spark, sf))
    follow, _ = D.clean_followup(X.followup(spark, sf))
    return D.site_codes(orphans(follow, base, K.KEYS)).select(*K.KEYS, "S56_1")


_RECODED = ["SITE_RC", *K.RECODES, *K.LADDERS, "AGE_RC", "MONEY_RC", "MONEY_RC_Cat", "TIMESINCEHIV", "BORNHIV_MCD", "TIMESINCEHIV_MCD"]
_DUMMY_NAMES = [
    f"{p}_{'RCR' if k == s.reference else 'RCD'}_{k}" for p, s in K.DUMMIES.items() for k in s.levels
]
_FLAG_NAMES = [
    *K.BOX_FLAGS,
    "DISC_RCD_Missing",
    "DRUG_RCD_Missing",
    "DISC_RCR_None",
    "DRUG_RCR_None",
    "DISC_RCD_Anyone",
    "DRUG_RCD_Uses",
]
_SCORES = [s.name for s in K.SCALES]


def _columns(names):
    def run(spark, sf):
        return study(spark, sf, names)

    return run


def study_scales(spark, sf):
    """Scores need the baseline answers only, so nothing is joined for them."""
    base, _ = D.clean_baseline(X.baseline(spark, sf))
    return D.derive(D.site_codes(D.trim_baseline(base)), only=[*_SCORES, "MENTALH4_RC"])


def _codebook(rows):
    book = D.study_codebook(D.extract(rows), exact_distinct=True)
    # logarithms of two engines may differ in their last digit
    ends = {c: F.when(F.col("type") == "double", F.round(F.col(c).cast("double"), 6).cast("string")).otherwise(F.col(c)) for c in ("min", "max")}
    return book.withColumns(ends)


def _table(build):
    def run(rows):
        t = build(rows)
        means = [c for c in ("mean", "sd") if c in t.columns]
        quartiles = [c for c in ("median", "q25", "q75") if c in t.columns]
        return round_cols(round_means(t, *means), 4, *quartiles).select(sorted(t.columns))

    return run


# --- SQL twins -----------------------------------------------------------------------------
def _any_equal(items: list[str]) -> str:
    known = " AND ".join(f'"{i}" IS NOT NULL' for i in items)
    hit = " OR ".join(f'"{i}" = 1' for i in items)
    return f"CASE WHEN {known} THEN {hit} END"


def _flag(cond: str) -> str:
    return f"CAST(({cond}) AS INTEGER)"


_OLDER = '("S56_24L" IS NOT NULL OR "S56_24X" IS NULL)'
_TICKED = " + ".join(f'coalesce("{c}", 0)' for c in K.SEARCH_ITEMS)
_NEW = {new: f'CASE WHEN "S56_24L" IS NOT NULL THEN "{old}" ELSE "{new}" END' for new, old in K.HARMONISED.items()}
_XTICKED = " + ".join(f"coalesce({e}, 0)" for e in _NEW.values())
_REST = ", ".join(
    f'"{c}"'
    for c in [*X.FOLLOWUP]
    if c not in ("S56_24",)
)


def _none_flag(ticked: str) -> str:
    return f'CASE WHEN "S56_23" = 7 THEN 9 WHEN "S56_23" <> 7 THEN CASE WHEN {ticked} > 0 THEN 0 ELSE 1 END END'


_HARMONISED_SQL = f"""SELECT k, SITE1, PID, {_REST},
  {", ".join(f'{e} AS "{c}"' for c, e in _NEW.items())},
  CASE WHEN older THEN u ELSE "S56_24U" END AS "S56_24U", CASE WHEN older THEN xv ELSE "S56_24XV" END AS "S56_24XV",
  CASE WHEN older THEN CASE WHEN u = 1 THEN 1 WHEN u <> 1 THEN t END ELSE "S56_24" END AS "S56_24",
  CASE WHEN older THEN CASE WHEN xv = 1 THEN 1 WHEN xv <> 1 THEN xt END ELSE "S56_24X" END AS "S56_24X"
FROM (SELECT *, {_OLDER} AS older, {_TICKED} AS t, {_XTICKED} AS xt, {_none_flag(_TICKED)} AS u, {_none_flag(_XTICKED)} AS xv
  FROM ({X.FOLLOWUP_SQL}))"""

_LINKED_SQL = f"""SELECT b.*, f.* EXCLUDE (k, SITE1, PID), CASE WHEN f.k IS NULL THEN 0 ELSE 1 END AS "Set",
  h.year AS "HIVDiagnosisYear_MCD", l.supp AS "ViralSupp_MCD", v.visited AS "CAREHV06_MCD",
  {", ".join(f'CASE WHEN f.k IS NOT NULL THEN s."{c}" END AS "{c}"' for c in X.SHEETS)}
FROM ({X.BASELINE_SQL}) b LEFT JOIN ({_HARMONISED_SQL}) f ON b.k = f.k
LEFT JOIN ({X.HISTORY_SQL}) h ON b.k = h.k
LEFT JOIN (SELECT k, supp FROM ({X.LABS_SQL}) WHERE supp IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY day, supp) = 1) l ON b.k = l.k
LEFT JOIN (SELECT i.k, CASE WHEN bool_or(date_diff('day', day, TODAY_D) BETWEEN 0 AND 183) THEN 1
    WHEN count(*) > count(day) THEN NULL ELSE 0 END AS visited
  FROM ({X.BASELINE_SQL}) i JOIN ({X.FOLLOWUP_SQL}) ff ON i.k = ff.k
  LEFT JOIN ({X.VISITS_SQL}) v0 ON i.k = v0.k GROUP BY i.k) v ON b.k = v.k
LEFT JOIN ({X.SHEET_SQL}) s ON b.k = s.k"""


def _recode_sql(spec: K.Recode) -> str:
    whens = " ".join(f"""WHEN "{spec.source}" = {c} THEN '{lab.replace("'", "''")}'""" for c, lab in spec.levels.items())
    out = f'CASE {whens} ELSE "{spec.source}"::VARCHAR END'
    return f'coalesce("{spec.override}", {out})' if spec.override else out


def _ladder_sql(spec: K.Ladder) -> str:
    whens = " ".join(f"""WHEN {cond} THEN '{lab.replace("'", "''")}'""" for cond, lab in spec.rules)
    parts = [f'"{spec.fallback_column}"'] if spec.fallback_column else []
    parts += [f"'{spec.default}'"] if spec.default else []
    return f"CASE {whens} ELSE {'coalesce(' + ', '.join(parts) + ')' if parts else 'NULL'} END"


_SITE_RC = "CASE SITE1 " + " ".join(f"WHEN '{c}' THEN '{lab}'" for c, lab in K.SITE_LABELS.items()) + " END"
_RC_SQL = f"""SELECT l.*, {_SITE_RC} AS "SITE_RC",
  {", ".join(f'{_recode_sql(s)} AS "{n}"' for n, s in K.RECODES.items())},
  {", ".join(f'{_ladder_sql(s)} AS "{n}"' for n, s in K.LADDERS.items())},
  CASE WHEN MONEY NOT IN (99997, 99998) THEN MONEY END AS "MONEY_RC",
  ln(1 + CASE WHEN MONEY NOT IN (99997, 99998) THEN MONEY END) AS "MONEY_RC_Log",
  CASE WHEN DIAGHIV <> 2099 THEN CAST(year(TODAY_D) AS INTEGER) - DIAGHIV WHEN DIAGHIV = 2099 THEN AGE_RC END AS "TIMESINCEHIV",
  CAST("HIVDiagnosisYear_MCD" = DOBY AS INTEGER) AS "BORNHIV_MCD",
  CAST(year(TODAY_D) AS INTEGER) - "HIVDiagnosisYear_MCD" AS "TIMESINCEHIV_MCD" FROM ({_LINKED_SQL}) l"""


def _dummy_sql(source: str, level) -> str:
    levels = level if isinstance(level, tuple) else (level,)
    quoted = ", ".join("'" + x.replace("'", "''") + "'" for x in levels)
    return f'CAST("{source}" IN ({quoted}) AS INTEGER)'


_DUMMIES_SQL = ", ".join(
    f'{_dummy_sql(s.source, lev)} AS "{p}_{"RCR" if k == s.reference else "RCD"}_{k}"'
    for p, s in K.DUMMIES.items()
    for k, lev in s.levels.items()
)


def _box_sql(spec: K.Boxes) -> str:
    text = f"""coalesce(contains("{spec.text}", '{spec.pattern}'), false)"""
    if spec.all_known:
        return _flag(f"({_any_equal(list(spec.boxes))}) OR {text}")
    return _flag(" OR ".join(f'"{b}" = 1' for b in spec.boxes) + f" OR {text}")


_BOXES_SQL = (
    ", ".join(f'{_box_sql(s)} AS "{n}"' for n, s in K.BOX_FLAGS.items())
    + ', CAST(NOT coalesce(DISC BETWEEN 1 AND 10, false) AS INTEGER) AS "DISC_RCD_Missing"'
    + ', CAST(DRUG1L = 98 AND DRUG2L = 98 AS INTEGER) AS "DRUG_RCD_Missing"'
)


def _none_sql(prefix: str) -> str:
    flags = [c for c in _FLAG_NAMES if c.startswith(prefix) and "RCD" in c and c not in ("DISC_RCD_Anyone", "DRUG_RCD_Uses")]
    return _flag(" AND ".join(f'"{c}" = 0' for c in flags))


def _item_sql(scale, item: str) -> str:
    base = f'"{item}"'
    for old, new in scale.remap.items():
        base = f"CASE WHEN {base} = {old} THEN {new} ELSE {base} END"
    out = f"CASE WHEN ({base}) <= {scale.max_valid} THEN ({base}) END"
    return f"({scale.reverse[item]} - ({out}))" if item in scale.reverse else f"({out})"


def _score_sql(s) -> str:
    items = [_item_sql(s, i) for i in s.items]
    total = " + ".join(f"coalesce({i}, 0)" if s.skip_null else i for i in items)
    empty = "NULL" if s.all_missing is None else str(s.all_missing)
    return f'CASE WHEN coalesce({", ".join(items)}) IS NULL THEN {empty} ELSE {total} END AS "{s.name}"'


def _outcome_sql(items: list[str], text: str | None) -> str:
    hit = f"({_any_equal(items)})"
    return _flag(f'{hit} OR coalesce("{text}", 0) = 1' if text else hit)


# Written once as a CTE; the flags that build on other flags come last.
STUDY_SQL = f"""s0 AS MATERIALIZED ({_RC_SQL}),
cut AS (SELECT quantile_cont("MONEY_RC_Log", 0.5) AS c FROM s0 WHERE "MONEY_RC_Log" <> 0),
s1 AS (SELECT s0.*, CASE WHEN "MONEY_RC_Log" IS NULL THEN 'Don''t know' WHEN "MONEY_RC_Log" = 0 THEN 'Zero'
  WHEN "MONEY_RC_Log" < c THEN 'Low' ELSE 'High' END AS "MONEY_RC_Cat" FROM s0 CROSS JOIN cut),
s2 AS (SELECT *, {_DUMMIES_SQL}, {_BOXES_SQL}, {", ".join(_score_sql(s) for s in K.SCALES)},
  {_item_sql(K.SINGLE_ITEMS[0], "MENTALH4")} AS "MENTALH4_RC",
  {", ".join(f'{_outcome_sql(items, text)} AS "{n}"' for n, (items, text) in K.OUTCOMES.items())} FROM s1),
s3 AS (SELECT *, {_none_sql("DISC")} AS "DISC_RCR_None", {_none_sql("DRUG")} AS "DRUG_RCR_None" FROM s2),
study AS MATERIALIZED (SELECT *, 1 - "DISC_RCR_None" AS "DISC_RCD_Anyone", 1 - "DRUG_RCR_None" AS "DRUG_RCD_Uses" FROM s3)"""


def _select(names: list[str], where: str = "") -> str:
    cols = ", ".join(f'"{n}"' for n in names)
    return f"WITH {STUDY_SQL} SELECT {cols} FROM study {where}"


_COHORT = """WHERE "Set" = 1 AND AGE >= 18 AND "HE_RC_HAL" IS NOT NULL AND "HE_RC_HSE" IS NOT NULL"""
_COHORT_SQL = f"""cohort AS MATERIALIZED (SELECT * REPLACE (
    CASE WHEN INJECTL = 1 THEN 'Injected drugs' WHEN INJECTL = 0 THEN 'Did not inject drugs' END AS "INJECTL_RC",
    CASE SCREEN5 WHEN 1 THEN 'Within past 12 months' WHEN 2 THEN 'More than 12 months ago' WHEN 7 THEN 'Don''t know'
      WHEN 8 THEN 'Refuse to answer' END AS SCREEN5,
    CASE "ViralSupp_MCD" WHEN 0 THEN 'Not suppressed' WHEN 1 THEN 'Suppressed' END AS "ViralSupp_MCD",
    CASE WHEN contains("S56_25S", 'NONE') THEN 0 ELSE "S56_25L" END AS "S56_25L",
    CASE WHEN regexp_matches("S56_26S", 'NONE|NOTHING|HIV') THEN 0 ELSE "S56_26N" END AS "S56_26N",
    CASE WHEN regexp_matches("S56_26S", 'HIV') THEN 1 ELSE "S56_26E" END AS "S56_26E"),
  CASE WHEN AGE < 25 THEN '18-24 Years' ELSE '25-34 Years' END AS "Age Groups",
  CASE WHEN DISCA = 0 THEN 'Disclosed' WHEN DISCA <> 0 THEN 'Did not disclose' END AS "DISC_RC",
  CAST("DRUG1LM" = 1 AND "DRUG2LK" = 1 AS INTEGER) AS "DRUG_RCD_None",
  {", ".join(f'''CASE {" ".join(f"""WHEN "{c}" = {code} THEN '{lab.replace("'", "''")}'""" for code, lab in levels.items())} END AS "{c}_L"''' for c, levels in K.TECH_RECODES.items())}
  FROM study {_COHORT})"""
_WITH = f"WITH {STUDY_SQL}, {_COHORT_SQL}"


def _factors(factors: dict[str, str], suffix: str = "") -> str:
    return " UNION ALL ".join(
        f"""SELECT * FROM ({factor_sql(f'SELECT "SITE_RC" AS grp, "{c}{suffix}"::VARCHAR AS level FROM cohort', h, groups=R.SITES)})"""
        for c, h in factors.items()
    )


_EMPTY = {
    "level": "CAST(NULL AS VARCHAR)",
    "level_n": "CAST(NULL AS BIGINT)",
    "total": "CAST(NULL AS BIGINT)",
    "share": "CAST(NULL AS DOUBLE)",
    "variable": "CAST(NULL AS VARCHAR)",
    "mean": "CAST(NULL AS DOUBLE)",
    "sd": "CAST(NULL AS DOUBLE)",
    "median": "CAST(NULL AS DOUBLE)",
    "q25": "CAST(NULL AS DOUBLE)",
    "q75": "CAST(NULL AS DOUBLE)",
    "range_min": "CAST(NULL AS DOUBLE)",
    "range_max": "CAST(NULL AS DOUBLE)",
}
_FACTOR_COLS = ["header", "level", "level_n", "grp", "is_overall", "n", "total", "share"]
_BINARY_COLS = ["header", "variable", "level", "level_n", "grp", "is_overall", "n", "total", "share"]
_MEAN_COLS = ["variable", "grp", "is_overall", "n", "mean", "sd", "range_min", "range_max", "header"]
_MEDIAN_COLS = ["variable", "grp", "is_overall", "n", "median", "q25", "q75", "range_min", "range_max", "header"]


def _report_sql(table: str, blocks: list[tuple[str, list[str]]]) -> str:
    names = sorted({c for _, cols in blocks for c in cols})
    parts = []
    for i, (sql, cols) in enumerate(blocks, 1):
        picked = ", ".join(f"{c if c in cols else _EMPTY[c]} AS {c}" for c in names)
        parts.append(f"SELECT '{table}' AS \"table\", {i} AS block, {picked} FROM ({sql})")
    return _WITH + " " + " UNION ALL ".join(parts)


_HIDDEN = " AND ".join(
    f"NOT (header = '{h}' AND level IN ({', '.join(repr(x) for x in levels)}))" for h, levels in K.TABLE2_HIDDEN.items()
)
_TABLE1_SQL = _report_sql(
    "Table 1",
    [
        (_factors(K.TABLE1_FACTORS), _FACTOR_COLS),
        (median_sql('SELECT * FROM cohort', '"SITE_RC"', "MONEY_RC", "Monthly Income"), _MEDIAN_COLS),
    ],
)
_TABLE2_SQL = _report_sql(
    "Table 2",
    [
        (
            f"SELECT * FROM ({_factors({**K.TABLE2_FACTORS, 'INJECTL_RC': 'Injected Substance Use'})}) WHERE {_HIDDEN}",
            _FACTOR_COLS,
        ),
        (
            binary_sql(
                'SELECT "SITE_RC" AS grp, ' + ", ".join(f'"{c}"' for c in K.TABLE2_DRUGS) + " FROM cohort",
                K.TABLE2_DRUGS,
                "Substance Use",
            ),
            _BINARY_COLS,
        ),
        (mean_sql("SELECT * FROM cohort", '"SITE_RC"', K.TABLE2_SCALES), _MEAN_COLS),
    ],
)
_ITEM, _HEADER, _LEVEL = K.TABLE3_INTERNET
_TABLE3_SQL = _report_sql(
    "Table 3",
    [
        (mean_sql("SELECT * FROM cohort", '"SITE_RC"', K.TABLE3_SCALES), _MEAN_COLS),
        (
            binary_sql(
                'SELECT "SITE_RC" AS grp, ' + ", ".join(f'"{c}"' for c in K.TABLE3_DEVICES) + " FROM cohort",
                K.TABLE3_DEVICES,
                "Device Use",
                3,
                (K.TABLE3_KEEP_DEVICE,),
            ),
            _BINARY_COLS,
        ),
        (
            factor_sql('SELECT "SITE_RC" AS grp, "S56_11_L" AS level FROM cohort', "SNS Used Most Often", 3, groups=R.SITES),
            _FACTOR_COLS,
        ),
        (f"SELECT * FROM ({_factors(K.TABLE3_OFTEN, '_L')}) WHERE level = '{K.OFTEN}'", _FACTOR_COLS),
        (f"SELECT * FROM ({_factors({_ITEM: _HEADER}, '_L')}) WHERE level = '{_LEVEL}'", _FACTOR_COLS),
    ],
)

_CHI_FACTORS = {**K.TABLE1_FACTORS, **K.TABLE2_FACTORS, **K.CHI_SQUARE_EXTRA}
_FIRST = ", ".join(f"'{h}'" for h in K.TABLE1_FACTORS.values())
_CHI_SQL = f"""{_WITH} SELECT *, round({chi2_p_sql("statistic", "df")}, 6) AS p,
  CASE WHEN header IN ({_FIRST}) THEN 'Table 1' ELSE 'Table 2' END AS "table" FROM ({chi_square_sql(
    f"SELECT header, level AS row, grp AS col, n FROM ({_factors(_CHI_FACTORS)}) WHERE is_overall = 0"
)})"""

_LABEL = {**K.ANALYSIS_LABELS, "MONEY_RC_Log": "Log Monthly Income"}
_LONG = " UNION ALL ".join(
    f"""SELECT '{v}' AS variable, '{_LABEL[v]}' AS label, '{t}' AS "table", SITE1 AS g, CAST("{v}" AS DOUBLE) AS v FROM cohort"""
    for v, t in K.ANOVA_VARIABLES.items()
)
_ANOVA_SQL = f"""{_WITH}, m AS (SELECT variable, label, "table", g, count(v) AS n, avg(v) AS m, count(v) / var_samp(v) AS w
  FROM ({_LONG}) GROUP BY ALL),
sm AS (SELECT *, sum(w) OVER p AS tw, sum(w * m) OVER p / sum(w) OVER p AS c, count(*) OVER p AS k
  FROM m WINDOW p AS (PARTITION BY variable)),
a AS (SELECT variable, label, "table", max(k) AS k, sum(w * (m - c) * (m - c)) AS b,
  sum((1 - w / tw) * (1 - w / tw) / (n - 1)) / (max(k) * max(k) - 1) AS lam FROM sm GROUP BY ALL),
t AS (SELECT variable, label, "table", b / ((k - 1) * (1 + 2 * (k - 2) * lam)) AS f, CAST(k - 1 AS DOUBLE) AS df1,
  1 / (3 * lam) AS df2 FROM a)
SELECT variable, label, "table", round(f, 4) AS f, df1, round(df2, 4) AS df2, round({f_p_sql("f", "df1", "df2")}, 4) AS p FROM t"""

_MERGED = "CASE WHEN \"RACE_RC\" = 'White Mixed-Race, Not Latino or Black' THEN 'White, Not Latino' ELSE \"RACE_RC\" END"
_ATTRITION_CELLS = " UNION ALL ".join(
    f"""SELECT * FROM (WITH b AS (SELECT "Set"::VARCHAR AS row, ({_MERGED if v == "RACE_RC" else f'"{v}"'})::VARCHAR AS col FROM study),
  bb AS (SELECT * FROM b WHERE col IS NOT NULL)
  SELECT '{v}' AS header, r.row, c.col, count(bb.row) AS n FROM (SELECT DISTINCT row FROM bb) r
  CROSS JOIN (SELECT DISTINCT col FROM bb) c LEFT JOIN bb ON bb.row = r.row AND bb.col = c.col GROUP BY r.row, c.col)"""
    for v in K.ATTRITION_FACTORS
)
_ATTRITION_SQL = f"""WITH {STUDY_SQL} SELECT *, round({chi2_p_sql("statistic", "df")}, 6) AS p,
  CASE WHEN header = 'RACE_RC' THEN '''White Mixed-Race, Not Latino or Black'' merged into ''White, Not Latino''' ELSE '' END AS note
  FROM ({chi_square_sql(_ATTRITION_CELLS)})"""


def _alpha_sql() -> str:
    parts = []
    for s in K.SCALES:
        items = [_item_sql(s, i) for i in s.items]
        k = len(items)
        var = " + ".join(f"var_samp({c})" for c in items)
        cov = " + ".join(f"covar_samp({items[a]}, {items[b]})" for a in range(k) for b in range(a + 1, k))
        parts.append(
            f"""SELECT '{s.label}' AS scale, round({k}::DOUBLE / {k - 1} * (1 - v / (v + 2 * c)), 4) AS alpha,
  {k} AS n_items, '{", ".join(i + "_RC" for i in s.items)}' AS items FROM (SELECT {var} AS v, {cov} AS c FROM study)"""
        )
    return f"WITH {STUDY_SQL} " + " UNION ALL ".join(parts)


def _outer(sql: str) -> str:
    return f"{_WITH} SELECT * FROM ({sql})"


_SEARCH = "SELECT * FROM cohort"
_ADULTS = """"AGE_RC" >= 18 AND "HE_RC_HAL" IS NOT NULL AND "HE_RC_HSE" IS NOT NULL"""


_TYPE = "CASE typeof(any_value(\"{c}\")) WHEN 'INTEGER' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END"


def _quoted(c: str) -> str:
    return f'"{c}"'


def _book_sql(c: str) -> str:
    label = "'" + K.ANALYSIS_LABELS[c].replace("'", "''") + "'" if c in K.ANALYSIS_LABELS else "NULL"
    return f"""SELECT '{c}' AS variable, {label} AS label, count(*) AS n_rows, count(*) - count("{c}") AS n_null,
  count(DISTINCT "{c}") AS n_distinct, {_TYPE.format(c=c)} AS type,
  {", ".join(f'CAST({f"round({end}({_quoted(c)}), 6)" if c.endswith("_Log") else f"{end}({_quoted(c)})"} AS VARCHAR) AS {end}' for end in ("min", "max"))},
  CAST(count(*) FILTER (WHERE "{c}" IN (0, 1)) = count("{c}") AND count("{c}") > 0 AS INTEGER) AS is_binary
  FROM kept WHERE (SELECT count(*) <> count(*) FILTER (WHERE "{c}" = 0) FROM followed) HAVING count(*) > 0"""


_CODEBOOK_SQL = f"""WITH {STUDY_SQL}, followed AS MATERIALIZED (SELECT * FROM study WHERE "Set" = 1),
kept AS MATERIALIZED (SELECT * FROM followed WHERE {_ADULTS}) """ + " UNION ALL ".join(_book_sql(c) for c in K.ANALYSIS_COLUMNS)
_STUDY_ROWS = "SELECT * FROM study"
_LOGITS_SQL = f"WITH {STUDY_SQL} " + " UNION ALL ".join(
    logit_sql(f'"{v}"', v, _STUDY_ROWS, (4, 4, 6)) for v in K.ATTRITION_PREDICTORS
)

QUERIES = {
    "study_harmonised": (
        study_harmonised,
        f"""SELECT SITE1, PID, "S56_24", "S56_24U", "S56_24X", "S56_24XV", {", ".join(f'"{c}"' for c in K.HARMONISED)}
  FROM ({_HARMONISED_SQL})""",
    ),
    "study_linked": (
        study_linked,
        f"""SELECT SITE1, PID, "Set", AGE, "HIVDiagnosisYear_MCD", "ViralSupp_MCD", "CAREHV06_MCD",
  {", ".join(f'"{c}"' for c in X.SHEETS)}, "S56_25A" FROM ({_LINKED_SQL})""",
    ),
    "study_orphans": (
        study_orphans,
        f"""SELECT SITE1, PID, "S56_1" FROM ({X.FOLLOWUP_SQL}) WHERE k NOT IN (SELECT k FROM ({X.BASELINE_SQL}))""",
    ),
    "study_recodes": (_columns(_RECODED), _select([*K.KEYS, *_RECODED])),
    "study_dummies": (_columns(_DUMMY_NAMES), _select([*K.KEYS, *_DUMMY_NAMES])),
    "study_flags": (_columns(_FLAG_NAMES), _select([*K.KEYS, *_FLAG_NAMES])),
    "study_scales": (study_scales, _select([*K.KEYS, *_SCORES, "MENTALH4_RC"])),
    "study_outcomes": (_columns(list(K.OUTCOMES)), _select([*K.KEYS, *K.OUTCOMES])),
    "study_extract": (
        _report("extract", D.extract),
        _select(
            K.ANALYSIS_COLUMNS,
            """WHERE "Set" = 1 AND "AGE_RC" >= 18 AND "HE_RC_HAL" IS NOT NULL AND "HE_RC_HSE" IS NOT NULL""",
        ),
    ),
    "study_codebook": (_report("extract", _codebook, often=True), _CODEBOOK_SQL),
    "study_table1": (_report("table1", _table(R.table1), often=True), _TABLE1_SQL),
    "study_table2": (_report("table2", _table(R.table2), often=True), _TABLE2_SQL),
    "study_table3": (_report("table3", _table(R.table3), often=True), _TABLE3_SQL),
    "study_site_chi_squares": (
        _report("site_chi_squares", lambda rows: round_cols(R.site_chi_squares(rows), 6, "statistic", "p"), often=True),
        _CHI_SQL,
    ),
    "study_site_anovas": (
        _report("site_anovas", lambda rows: round_cols(R.site_anovas(rows), 4, "f", "df2", "p"), often=True),
        _ANOVA_SQL,
    ),
    "study_search_items": (
        _report("search_items", R.search_items),
        _outer(items_sql(_SEARCH, K.HEALTH_QUESTIONS)),
    ),
    "study_search_items_by_age": (
        _report("search_items", lambda rows: R.search_items(rows, ["Age Groups"])),
        _outer(items_sql(_SEARCH, K.HEALTH_QUESTIONS, '"Age Groups"')),
    ),
    "study_search_categories": (
        _report("search_categories", R.search_categories),
        _outer(categories_sql(_SEARCH, K.HEALTH_QUESTIONS)),
    ),
    "study_search_categories_by_age": (
        _report("search_categories", lambda rows: R.search_categories(rows, ["Age Groups"])),
        _outer(categories_sql(_SEARCH, K.HEALTH_QUESTIONS, '"Age Groups"')),
    ),
    "study_platform_items": (
        _report("platform_items", R.platform_items),
        _outer(items_sql(_SEARCH, K.COMM_QUESTIONS, None, "rows", False)),
    ),
    "study_platform_items_by_age": (
        _report("platform_items", lambda rows: R.platform_items(rows, ["Age Groups"])),
        _outer(items_sql(_SEARCH, K.COMM_QUESTIONS, '"Age Groups"', "rows", False)),
    ),
    "study_platform_categories": (
        _report("platform_categories", R.platform_categories),
        _outer(categories_sql(_SEARCH, K.COMM_QUESTIONS)),
    ),
    "study_platform_categories_by_age": (
        _report("platform_categories", lambda rows: R.platform_categories(rows, ["Age Groups"])),
        _outer(categories_sql(_SEARCH, K.COMM_QUESTIONS, '"Age Groups"')),
    ),
    "study_reliabilities": (
        _report("reliabilities", lambda rows: round_cols(R.reliabilities(rows), 4, "alpha")),
        _alpha_sql(),
    ),
    "study_attrition_categorical": (
        _report("attrition_categorical", lambda rows: round_cols(R.attrition_categorical(rows), 6, "statistic", "p"), often=True),
        _ATTRITION_SQL,
    ),
    "study_attrition_continuous": (
        _report(
            "attrition_continuous",
            lambda rows: round_cols(
                round_cols(R.attrition_continuous(rows), 4, "intercept", "slope", "z", "p"), 6, "std_error"
            ),
        ),
        _LOGITS_SQL,
    ),
    "study_attrition_residuals": (
        _report(
            "attrition_continuous",
            lambda rows: round_cols(R.attrition_residuals(rows, "AGE"), 4, "mean_x", "mean_residual", "band"),
        ),
        residuals_sql("AGE", _STUDY_ROWS, STUDY_SQL),
    ),
    "study_rejects": (
        study_rejects,
        f"""SELECT SITE1, PID, "S56_1", "S56_2S" FROM (
  SELECT list_extract({X.SITE_SQL}, site_no) AS SITE1, PID, {X.answer_sql("S56_1", X.FOLLOWUP["S56_1"])} AS "S56_1",
    {X.answer_sql("S56_2S", X.FOLLOWUP["S56_2S"])} AS "S56_2S" FROM ({X._PEOPLE_SQL}) WHERE k % 11 NOT IN {X._LOST})
  WHERE "S56_1" IS NULL OR coalesce(contains("S56_2S", '.....'), false)""",
    ),
}
