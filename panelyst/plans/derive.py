"""From raw waves and chart extracts to the linked, recoded, scored table.

Each step is a projection or an equi-join on (site, participant). Derived
variables are dictionaries of column expressions, put into as few projections as
their dependencies allow.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyst.functions import nulls as N
from panelyst.functions import scalars as S
from panelyst.operators import clean, columns, link, recode, scales
from panelyst.operators.codebook import analysis_extract, codebook
from panelyst.plans import catalog as K
from panelyst.plans import needs


# --- charts ---------------------------------------------------------------------
def chart_dates(df: DataFrame) -> DataFrame:
    """Day numbers to dates in every date column except the origin."""
    names = [c for c in columns.containing(df, "ReportingPeriod", "Date") if c != "OriginDate"]
    return columns.map_columns(df, names, S.from_day_number)


def chart_keys(df: DataFrame, xwalk: DataFrame) -> DataFrame:
    """Site and participant ids as the survey writes them."""
    padded = clean.pad_subgroup(df, "SiteSpecificID", F.col("SiteID") == K.PADDED_SITE, K.PADDED_WIDTH)
    rekeyed = link.rekey_subgroup(
        padded, xwalk, F.col("SiteID") == K.REKEYED_SITE, "SiteSpecificID", "PID", out="PID"
    )
    return rekeyed.withColumnRenamed("SiteID", "SITE1")


def diagnosis_year(history: DataFrame, xwalk: DataFrame) -> DataFrame:
    return chart_keys(history.select("SiteID", "SiteSpecificID", "HIVDiagnosisYear"), xwalk).select(
        *K.KEYS, F.col("HIVDiagnosisYear").alias("HIVDiagnosisYear_MCD")
    )


def first_lab(labs: DataFrame, xwalk: DataFrame) -> DataFrame:
    """Suppression at the earliest lab; the lower value on a tie of dates."""
    dated = chart_dates(labs.select("SiteID", "SiteSpecificID", "ServiceDate", "ViralSupp"))
    first = link.first_value_by_date(
        dated, ["SiteID", "SiteSpecificID"], "ViralSupp", "ServiceDate", ["ViralSupp"], "ViralSupp_MCD"
    )
    return chart_keys(first, xwalk).select(*K.KEYS, "ViralSupp_MCD")


def visits(amb: DataFrame, xwalk: DataFrame) -> DataFrame:
    """One row per participant and visit day."""
    days = chart_dates(amb.select("SiteID", "SiteSpecificID", "ServiceDate")).distinct()
    return chart_keys(days, xwalk).select(*K.KEYS, "ServiceDate")


# --- waves ----------------------------------------------------------------------
def _only(df: DataFrame, needed: set[str] | None) -> DataFrame:
    """The keys and those columns that are needed."""
    return df if needed is None else df.select([c for c in df.columns if c in needed or c in K.KEYS])


def clean_baseline(raw: DataFrame, needed: set[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Valid baseline rows, scrubbed and without empty columns; and the rejects.

    With ``needed`` those columns stay and no others, empty or not, and no job is run to find the empty ones.
    """
    valid, rejects = clean.split_valid(raw, F.col("MTUEX1").isNull())
    if needed is None:
        valid = columns.drop_all_null(clean.token_to_null(valid))
    else:
        valid = clean.token_to_null(_only(valid, needed))
    if "AGE" not in valid.columns:
        return valid, rejects
    wrong_age = (F.col("SITE1") == 10) & (F.col("PID") == "0020") & (F.col("AGE") == -1)
    return clean.correct_where(valid, "AGE", 19, wrong_age), rejects


def clean_followup(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    valid, rejects = clean.split_valid(raw, F.col("S56_1").isNull() | N.matches("S56_2S", clean.DOT_RUN))
    return clean.token_to_null(valid), rejects


def harmonise_followup(df: DataFrame) -> DataFrame:
    """One questionnaire out of three versions, told apart by which items are there.

    The oldest version asked the extra search items under names that were later
    retired. Both older versions lack the summary items, which are derived:
    whether none applied, and how many did.
    """
    oldest = F.col("S56_24L").isNotNull()
    flagged = df.withColumn("_older", oldest | F.col("S56_24X").isNull())
    out = link.harmonise_versions(flagged, K.HARMONISED, oldest)
    older = F.col("_older")
    for none_flag, total, items in (
        ("S56_24U", "S56_24", columns.existing(out, K.SEARCH_ITEMS)),
        ("S56_24XV", "S56_24X", columns.existing(out, K.EXTRA_SEARCH_ITEMS)),
    ):
        ticked = N.row_sum(items)
        none = N.if_else(
            F.col(K.SEARCH_FREQUENCY) == K.NEVER_SEARCHES,
            F.lit(K.NOT_ASKED),
            F.when(ticked > 0, 0).otherwise(1),
        )
        out = out.withColumn(none_flag, F.when(older, none).otherwise(F.col(none_flag)))
        summed = N.if_else(F.col(none_flag) == 1, F.lit(1), ticked)
        out = out.withColumn(total, F.when(older, summed).otherwise(F.col(total)))
    return out.drop("_older")


def trim_baseline(df: DataFrame) -> DataFrame:
    wanted = {
        *K.BASELINE_NAMES,
        *columns.starting_with(df, *K.BASELINE_PREFIXES),
        *[c for p in K.BASELINE_PATTERNS for c in columns.matching(df, p)],
    }
    return columns.key_first(df.select([c for c in df.columns if c in wanted]), *K.KEYS)


def site_codes(df: DataFrame) -> DataFrame:
    return df.withColumn("SITE1", recode.recode("SITE1", K.SITE_CODES))


def link_study(
    baseline: DataFrame,
    followup: DataFrame,
    history: DataFrame,
    labs: DataFrame,
    amb: DataFrame,
    xwalk: DataFrame,
    sheets: Mapping[str, DataFrame],
    validate: bool = True,
    needed: set[str] | None = None,
) -> DataFrame:
    """Both waves, chart facts and adjudicated texts in one row per participant.

    Adjudicated texts and visits only exist for participants with a follow-up. With ``needed`` (see
    ``needs.closure``) only those columns are there, and extracts that hold none of them are not joined.
    """

    def asked(name: str) -> bool:
        return needed is None or name in needed

    whole = site_codes(trim_baseline(baseline))
    first, second = _only(whole, needed), site_codes(followup)
    answers = _only(second.select(*K.KEYS, *columns.starting_with(second, "S56")), needed)
    linked = link.link_waves(first, answers, K.KEYS, validate=validate)
    if asked("HIVDiagnosisYear_MCD"):
        linked = link.attach(linked, diagnosis_year(history, xwalk), K.KEYS)
    if asked("ViralSupp_MCD"):
        linked = link.attach(linked, first_lab(labs, xwalk), K.KEYS)
    if asked("CAREHV06_MCD"):
        index = whole.select(*K.KEYS, S.parse_date("TODAY").alias("TODAY"))
        visited = link.visit_in_window(
            index, visits(amb, xwalk), K.KEYS, "TODAY", "ServiceDate", out="CAREHV06_MCD"
        )
        linked = link.attach(linked, visited, K.KEYS)
    for sheet in sheets.values():
        texts = [c for c in columns.existing(sheet, K.RECODE_COLUMNS) if asked(c)]
        if texts:
            linked = link.attach(linked, sheet.select(*K.KEYS, *texts), K.KEYS)
    followed = F.col("Set") == 1
    only_followed = columns.existing(linked, [*K.RECODE_COLUMNS, "CAREHV06_MCD"])
    return linked.withColumns({c: F.when(followed, F.col(c)) for c in only_followed}) if only_followed else linked


# --- derived variables ------------------------------------------------------------
def _ladder(spec: K.Ladder) -> Column:
    rules = [(F.expr(cond), label) for cond, label in spec.rules]
    if spec.fallback_column and spec.default:
        fallback = F.coalesce(F.col(spec.fallback_column), F.lit(spec.default))
    elif spec.fallback_column:
        fallback = F.col(spec.fallback_column)
    else:
        fallback = F.lit(spec.default) if spec.default else None
    return recode.ladder(rules, fallback)


def _all(name: str) -> bool:
    return True


def recodes(asked: Callable[[str], bool] = _all) -> dict[str, Column]:
    out = {"SITE_RC": recode.recode("SITE1", K.SITE_LABELS)} if asked("SITE_RC") else {}
    for name, spec in K.RECODES.items():
        if asked(name):
            label = recode.recode(spec.source, spec.levels)
            out[name] = recode.override(spec.override, label) if spec.override else label
    return out | {name: _ladder(spec) for name, spec in K.LADDERS.items() if asked(name)}


def time_and_money() -> dict[str, Column]:
    today = S.parse_date("TODAY")
    age = S.age_years(today, S.parse_date("DOB"))
    money = S.coalesce_codes("MONEY", K.MONEY_UNKNOWN)
    return {
        "AGE_RC": age,
        "MONEY_RC": money,
        "MONEY_RC_Log": S.log_plus_one(money),
        "TIMESINCEHIV": recode.years_since_event(today, "DIAGHIV", K.SINCE_BIRTH, age),
        "BORNHIV_MCD": recode.same_year("HIVDiagnosisYear_MCD", "DOBY"),
        "TIMESINCEHIV_MCD": S.years_since(today, "HIVDiagnosisYear_MCD"),
    }


def box_flags(asked: Callable[[str], bool] = _all) -> dict[str, Column]:
    """Disclosure and drug flags."""
    out = {}
    for name, spec in K.BOX_FLAGS.items():
        if not asked(name):
            continue
        if spec.all_known:
            out[name] = N.indicator(N.any_equal(spec.boxes) | N.matches(spec.text, spec.pattern))
        else:
            out[name] = recode.multi_select(spec.boxes, spec.text, spec.pattern)
    out["DISC_RCD_Missing"] = recode.not_among("DISC", list(K.DISC_VALID))
    out["DRUG_RCD_Missing"] = N.indicator(
        (F.col("DRUG1L") == K.REFUSED) & (F.col("DRUG2L") == K.REFUSED)
    )
    return out


def outcomes(asked: Callable[[str], bool] = _all) -> dict[str, Column]:
    out = {}
    for name, (items, text) in K.OUTCOMES.items():
        if asked(name):
            hit = N.any_equal(items)
            out[name] = N.indicator(hit | (F.coalesce(F.col(text), F.lit(0)) == 1) if text else hit)
    return out


def clean_answers(asked: Callable[[str], bool] = _all) -> dict[str, Column]:
    """The cleaned items of all scales."""
    found = [*K.SINGLE_ITEMS, *K.SCALES]
    return scales.cleaned([s for s in found if any(asked(f"{i}_RC") for i in s.items)])


def dummy_columns(prefixes: list[str], asked: Callable[[str], bool] = _all) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for prefix in prefixes:
        spec = K.DUMMIES[prefix]
        if any(map(asked, needs.dummy_names(prefix))):
            out |= recode.dummies(spec.source, prefix, spec.levels, spec.reference)
    return out


def derive(linked: DataFrame, baseline: DataFrame | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """All derived variables of the linked table, in three projections; or ``only`` those and what they build on.

    The table is too wide for whole-stage code, so every projection copies its
    rows; variables are therefore grouped by what they build on, not by topic.
    ``baseline`` is where the income median is taken from: it has the same incomes
    as the linked table and no joins to redo. ``only`` may name answers and facts too; a name that is neither
    there nor derived is left out.
    """
    have = set(linked.columns)
    known = None if only is None else needs.closure(only)

    def asked(name: str) -> bool:
        return known is None or name in known

    texts = [c for c in K.RECODE_COLUMNS if c.startswith("outcome") and asked(c) and (only is None or c in have)]
    from_answers = (
        recodes(asked)
        | time_and_money()
        | box_flags(asked)
        | outcomes(asked)
        | clean_answers(asked)
        | {c: F.coalesce(F.col(c), F.lit(0)) for c in texts}
    )
    from_recodes = (
        {"MONEY_RC_Cat": F.lit(None)}
        | dummy_columns([p for p in K.DUMMIES if p != "MONEY"], asked)
        | {s.name: scales.score(s) for s in K.SCALES if asked(s.name)}
        | {f"{p}_RCR_None": recode.none_of(names) for p, names in needs.flag_groups().items() if asked(f"{p}_RCR_None")}
    )
    last = dummy_columns(["MONEY"], asked) | {
        "DISC_RCD_Anyone": recode.complement("DISC_RCR_None"),
        "DRUG_RCD_Uses": recode.complement("DRUG_RCR_None"),
    }
    layers = [{n: c for n, c in layer.items() if asked(n)} for layer in (from_answers, from_recodes, last)]
    if "MONEY_RC_Cat" in layers[1]:
        source = (linked if baseline is None else baseline).select(time_and_money()["MONEY_RC_Log"].alias("m"))
        layers[1]["MONEY_RC_Cat"] = recode.split_at("MONEY_RC_Log", recode.non_zero_median(source, "m"))
    out = linked
    for layer in layers:
        out = out.withColumns(layer) if layer else out
    if only is None:
        return out
    names = dict.fromkeys([*[c for c in K.KEYS if c in have], *only])
    return out.select(*columns.existing(out, list(names)))


def extract(study: DataFrame) -> DataFrame:
    """The analysis table: followed-up adults with both engagement scores."""
    return analysis_extract(
        study,
        columns.existing(study, K.ANALYSIS_COLUMNS),
        F.col("Set") == 1,
        F.col("AGE_RC") >= 18,
        ["HE_RC_HAL", "HE_RC_HSE"],
    )


def study_codebook(analysis: DataFrame, exact_distinct: bool = False) -> DataFrame:
    labels = analysis.sparkSession.createDataFrame(
        list(K.ANALYSIS_LABELS.items()), "variable string, label string"
    )
    return codebook(analysis, labels, exact_distinct=exact_distinct)
