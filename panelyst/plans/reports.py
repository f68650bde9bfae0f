"""The study's tables, prevalence summaries, tests and reliabilities.

Each function reads the derived table once per kind of summary; write that table
with ``sources.sinks.materialise`` first when several reports are wanted.
``READS`` names the variables each report looks at: link and derive those (``needs.closure``), not all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyst.functions.nulls import indicator, is_in
from panelyst.operators import clean, prevalence, recode, scales, stats, tables
from panelyst.plans import catalog as K

SITES = list(K.SITE_LABELS.values())

_COHORT = ["Set", "AGE", "HE_RC_HAL", "HE_RC_HSE"]
#: Labels that reports make themselves, and what from.
_MADE = {"DISC_RC": ["DISCA"], "DRUG_RCD_None": ["DRUG1LM", "DRUG2LK"], "INJECTL_RC": ["INJECTL"]}
#: Search items that a free text may set right: item, text, pattern, value.
_SET_RIGHT = (
    ("S56_25L", "S56_25S", "NONE", 0),
    ("S56_26N", "S56_26S", "NONE|NOTHING|HIV", 0),
    ("S56_26E", "S56_26S", "HIV", 1),
)


def _looks_at(*names: str) -> list[str]:
    return list(dict.fromkeys([*_COHORT, *[x for n in names for x in _MADE.get(n, [n])]]))


_SEARCHED = _looks_at(*[q.variable for q in K.HEALTH_QUESTIONS], *[x for rule in _SET_RIGHT for x in rule[:2]])
_TALKED = _looks_at(*[q.variable for q in K.COMM_QUESTIONS])
READS: dict[str, list[str]] = {
    "table1": _looks_at("SITE_RC", "MONEY_RC", *K.TABLE1_FACTORS),
    "table2": _looks_at("SITE_RC", "INJECTL_RC", *K.TABLE2_FACTORS, *K.TABLE2_DRUGS, *K.TABLE2_SCALES),
    "table3": _looks_at("SITE_RC", "S56_11", *K.TABLE3_SCALES, *K.TABLE3_DEVICES, *K.TABLE3_OFTEN, K.TABLE3_INTERNET[0]),
    "site_chi_squares": _looks_at("SITE_RC", *K.TABLE1_FACTORS, *K.TABLE2_FACTORS, *K.CHI_SQUARE_EXTRA),
    "site_anovas": _looks_at("SITE1", *K.ANOVA_VARIABLES),
    "search_items": _SEARCHED,
    "search_categories": _SEARCHED,
    "platform_items": _TALKED,
    "platform_categories": _TALKED,
    "reliabilities": [f"{i}_RC" for s in K.SCALES for i in s.items],
    "attrition_categorical": ["Set", *K.ATTRITION_FACTORS],
    "attrition_continuous": ["Set", *K.ATTRITION_PREDICTORS],
    "extract": list(dict.fromkeys([*K.ANALYSIS_COLUMNS, "Set", "AGE_RC", "HE_RC_HAL", "HE_RC_HSE"])),
}


def cohort(study: DataFrame, age: str = "AGE") -> DataFrame:
    """Followed-up adults with both engagement scores, with their age group."""
    rows = study.where((F.col("Set") == 1) & (F.col(age) >= 18)).dropna(subset=["HE_RC_HAL", "HE_RC_HSE"])
    return rows.withColumn("Age Groups", recode.band(age, K.AGE_EDGES, K.AGE_LABELS))


def participant_answers(study: DataFrame) -> DataFrame:
    """The cohort with the answers of tables 1 and 2 as labels, as far as the answers are there."""
    have = set(study.columns)
    out = {c: recode.recode(c, levels) for c, levels in K.REPORT_RECODES.items() if c in have}
    made = {
        "DISC_RC": F.when(F.col("DISCA") == 0, "Disclosed").when(F.col("DISCA") != 0, "Did not disclose"),
        "DRUG_RCD_None": indicator((F.col("DRUG1LM") == 1) & (F.col("DRUG2LK") == 1)),
        "INJECTL_RC": F.when(F.col("INJECTL") == 1, "Injected drugs").when(F.col("INJECTL") == 0, "Did not inject drugs"),
    }
    out |= {name: c for name, c in made.items() if have.issuperset(_MADE[name])}
    return cohort(study).withColumns(out)


def _shown(table: DataFrame, hidden: dict[str, list[str]]) -> DataFrame:
    """Leave out the levels a table does not print; totals stay as they are."""
    for header, levels in hidden.items():
        table = table.where(~((F.col("header") == header) & is_in("level", levels)))
    return table


def table1(study: DataFrame) -> DataFrame:
    demo = participant_answers(study)
    return tables.report(
        {
            "Table 1": [
                tables.one_factor_tables(demo, "SITE_RC", K.TABLE1_FACTORS, SITES),
                tables.continuous_tables(demo, "SITE_RC", {"MONEY_RC": "Monthly Income"}, "median"),
            ]
        }
    )


def table2(study: DataFrame) -> DataFrame:
    demo = participant_answers(study)
    factors = {**K.TABLE2_FACTORS, "INJECTL_RC": "Injected Substance Use"}
    return tables.report(
        {
            "Table 2": [
                _shown(tables.one_factor_tables(demo, "SITE_RC", factors, SITES), K.TABLE2_HIDDEN),
                tables.many_binary_table(demo, "SITE_RC", K.TABLE2_DRUGS, "Substance Use", groups=SITES),
                tables.continuous_tables(demo, "SITE_RC", K.TABLE2_SCALES, "mean"),
            ]
        }
    )


def tech_answers(study: DataFrame) -> DataFrame:
    return cohort(study).withColumns(
        {c: recode.recode(c, levels) for c, levels in K.TECH_RECODES.items() if c in study.columns}
    )


def table3(study: DataFrame) -> DataFrame:
    tech = tech_answers(study)
    item, header, level = K.TABLE3_INTERNET
    shares = tables.one_factor_tables(tech, "SITE_RC", {**K.TABLE3_OFTEN, item: header}, SITES)
    often = shares.where((F.col("header") != header) & (F.col("level") == K.OFTEN))
    internet = shares.where((F.col("header") == header) & (F.col("level") == level))
    return tables.report(
        {
            "Table 3": [
                tables.continuous_tables(tech, "SITE_RC", K.TABLE3_SCALES, "mean"),
                tables.many_binary_table(
                    tech, "SITE_RC", K.TABLE3_DEVICES, "Device Use", n=3, keep=[K.TABLE3_KEEP_DEVICE], groups=SITES
                ),
                tables.one_factor_table(tech, "SITE_RC", "S56_11", "SNS Used Most Often", n=3, groups=SITES),
                often,
                internet,
            ]
        }
    )


def site_chi_squares(study: DataFrame) -> DataFrame:
    """Each categorical characteristic against site."""
    demo = participant_answers(study)
    factors = {**K.TABLE1_FACTORS, **K.TABLE2_FACTORS, **K.CHI_SQUARE_EXTRA}
    tests = stats.with_chi2_p(stats.factor_chi_squares(demo, "SITE_RC", factors, SITES))
    first = is_in("header", list(K.TABLE1_FACTORS.values()))
    return tests.withColumn("table", F.when(first, "Table 1").otherwise("Table 2"))


def site_anovas(study: DataFrame) -> DataFrame:
    """Each scale against site, with its label and table."""
    tests = stats.with_f_p(stats.welch_anova(cohort(study), "SITE1", list(K.ANOVA_VARIABLES)))
    label = {**K.ANALYSIS_LABELS, "MONEY_RC_Log": "Log Monthly Income"}
    return tests.withColumns(
        {
            "label": recode.recode("variable", {v: label[v] for v in K.ANOVA_VARIABLES}),
            "table": recode.recode("variable", K.ANOVA_VARIABLES),
        }
    )


def search_answers(study: DataFrame) -> DataFrame:
    """The cohort with the search items set right by their free texts."""
    rows = cohort(study)
    for item, text, pattern, value in _SET_RIGHT:
        rows = clean.override_from_text(rows, item, text, pattern, value)
    return rows


def search_items(study: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return prevalence.item_prevalence(search_answers(study), K.HEALTH_QUESTIONS, groups)


def search_categories(study: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return prevalence.category_prevalence(search_answers(study), K.HEALTH_QUESTIONS, groups)


def platform_items(study: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return prevalence.item_prevalence(cohort(study), K.COMM_QUESTIONS, groups, "rows", any_rows=False)


def platform_categories(study: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return prevalence.category_prevalence(cohort(study), K.COMM_QUESTIONS, groups)


def reliabilities(study: DataFrame) -> DataFrame:
    return scales.cronbach_alpha(study, K.SCALES)


def attrition_categorical(study: DataFrame) -> DataFrame:
    return stats.with_chi2_p(
        stats.attrition_chi_square(study, K.ATTRITION_FACTORS, "Set", K.ATTRITION_MERGE)
    )


def attrition_continuous(study: DataFrame) -> DataFrame:
    return stats.with_normal_p(stats.logit_wald(study, "Set", K.ATTRITION_PREDICTORS))


def attrition_residuals(study: DataFrame, predictor: str) -> DataFrame:
    """Binned residuals of the retention logit on one predictor, as many bins as the root of the rows; none without a fit."""
    fit = stats.logit_wald(study, "Set", [predictor]).first()
    rows = study.where(F.lit(bool(fit["converged"])))
    return stats.binned_residuals(
        rows, "Set", predictor, fit["intercept"] or 0.0, fit["slope"] or 0.0, bins=F.floor(F.sqrt("total"))
    )
