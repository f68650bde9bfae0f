"""The study's derivation on frames made from the smallest driver tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from panelyst.operators.tables import ordered_levels
from panelyst.plans import catalog as K
from panelyst.plans import derive as D
from panelyst.plans import reports as R
from panelyst.queries import study as Q
from panelyst.sources.sinks import materialise

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def study(spark):
    return materialise(Q.study(spark, SF))


def test_catalog_is_consistent():
    assert len(K.SCALES) == 14 and [len(s.items) for s in K.SCALES] == [3, 10, 4, 5, 10, 3, 4, 3, 9, 4, 9, 6, 3, 3]
    assert len(K.HEALTH_QUESTIONS) == 29 and len(K.COMM_QUESTIONS) == 76
    assert len(K.ANALYSIS_LABELS) == 62
    variables = [q.variable for q in K.HEALTH_QUESTIONS + K.COMM_QUESTIONS]
    assert len(set(variables)) == len(variables)


def test_dummies_of_a_known_level_sum_to_one(study):
    for prefix, spec in K.DUMMIES.items():
        names = [f"{prefix}_{'RCR' if k == spec.reference else 'RCD'}_{k}" for k in spec.levels]
        labels = [x for v in spec.levels.values() for x in (v if isinstance(v, tuple) else (v,))]
        total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
        assert study.where(F.col(spec.source).isin(labels) & (total != 1)).count() == 0, prefix
        assert study.where(F.col(spec.source).isNull() & total.isNotNull()).count() == 0, prefix


def test_scores_stay_in_range(study):
    lows = study.agg(*[F.min(s.name).alias(s.name) for s in K.SCALES]).first()
    highs = study.agg(*[F.max(s.name).alias(s.name) for s in K.SCALES]).first()
    for s in K.SCALES:
        assert 0 <= lows[s.name] and highs[s.name] <= s.max_valid * len(s.items)
    assert study.where("CARE_RC IS NULL").count() == 0


def test_lost_participants_have_no_followup_facts(study):
    lost = study.where("Set = 0")
    assert lost.count() > 0
    texts = [c for c in K.RECODE_COLUMNS if not c.startswith("outcome")]
    assert lost.where(F.coalesce(*[F.col(c) for c in texts]).isNotNull()).count() == 0
    assert lost.where("CAREHV06_MCD_RC <> 'Missing'").count() == 0
    assert lost.where("outcome_Comms_SexHealth IS NOT NULL").count() == 0


def test_extract_and_codebook(study):
    analysis = materialise(D.extract(study))
    assert analysis.where("AGE_RC < 18 OR HE_RC_HAL IS NULL OR HE_RC_HSE IS NULL").count() == 0
    book = {r["variable"]: r for r in D.study_codebook(analysis).collect()}
    assert set(book) == set(analysis.columns)
    assert book["SOCIALS_RC"]["label"] == "Social Support Scale" and book["SOCIALS_RC"]["is_binary"] == 0
    assert book["DRUG_RCD_Alcohol"]["is_binary"] == 1


def test_report_order(study):
    first = R.table1(study).where("block = 1 AND is_overall = 1 AND header = 'Education'")
    levels = [r["level"] for r in ordered_levels(first, K.TABLE1_ORDER["Education"]).collect()]
    assert levels[:2] == ["High school, equivalent or less", "Some post-K12"]


def test_search_texts_override_items(study):
    rows = R.search_answers(study)
    assert rows.where("S56_26S LIKE '%HIV%' AND (S56_26N <> 0 OR S56_26E <> 1)").count() == 0


def test_reports_see_what_they_read_and_no_more(spark):
    """Each report works on its own variables, and its plan holds no answer that none of them is made from."""
    from panelyst.plans.needs import closure

    builders = {name: getattr(R, name) for name in R.READS if name != "extract"}
    raw = {*Q.X.BASELINE, *Q.X.FOLLOWUP, *Q.X.VERSIONED, *Q.X.SHEETS}
    for name, build in builders.items():
        rows = Q.study(spark, SF, R.READS[name])
        assert set(rows.columns) <= {*R.READS[name], *K.KEYS}, name
        (build(rows) if name != "attrition_continuous" else rows).schema  # all columns the report names are there
        needed = closure(R.READS[name])
        # names that validity and the questionnaire's version are told by
        needed |= {"MTUEX1", "S56_1", "S56_2S", K.SEARCH_FREQUENCY, *K.HARMONISED.values(), *K.SEARCH_ITEMS}
        held = {w for w in re.findall(r"(\w+)#\d+", rows._jdf.queryExecution().optimizedPlan().toString())}
        assert not (held & raw) - needed - {f"S56_24{x}" for x in ("U", "X", "XV", "")} - set(K.EXTRA_SEARCH_ITEMS), name
        if name == "search_items":
            assert "HIVDiagnosisYear" not in held and "ServiceDate" not in held and "DISCRECODE" not in held


def test_variables_name_all_they_are_made_from(spark, study):
    """A table of what the catalog says a variable reads is enough to derive it."""
    from panelyst.plans import needs

    made = needs.reads()
    everything = Q.linked(spark, SF)[0]
    kinds = {f.name: f.dataType.simpleString() for f in everything.schema.fields}
    derived = [c for c in study.columns if c not in kinds]
    assert set(derived) == set(made) - set(kinds)
    for name in [*derived[::9], *K.LADDERS, "MONEY_RC_Cat", "DISC_RCD_Anyone"]:
        raw = [c for c in needs.closure([name]) if c not in made]
        assert set(raw) <= set(kinds), name
        table = spark.createDataFrame([], ", ".join(f"`{c}` {kinds[c]}" for c in raw))
        assert D.derive(table, table, only=[name]).columns[-1] == name


BASE = "SITE1 int, PID string, TODAY string, DOB string, MTUEX1 int, AGE int, empty int, note string"


def test_baseline_cleaning(spark):
    raw = spark.createDataFrame(
        [
            (10, "0020", "2018-01-01", "1999-01-01", 3, -1, None, "x....."),
            (10, "0021", "2018-01-01", "1999-01-01", 3, -1, None, "fine"),
            (1, "0001", "2018-01-01", "1999-01-01", None, 20, None, "reject"),
        ],
        BASE,
    )
    valid, rejects = D.clean_baseline(raw)
    assert "empty" not in valid.columns and rejects.count() == 1
    assert {(r["PID"], r["AGE"], r["note"]) for r in valid.collect()} == {("0020", 19, None), ("0021", -1, "fine")}


def test_questionnaire_versions(spark):
    letters = "LMNOPQRS"
    cols = ["id", "S56_23", "S56_24", "S56_24U", "S56_24X", "S56_24XV", "S56_24A", "S56_24B"]
    cols += [f"S56_24{x}" for x in letters] + [f"S56_24X{x}" for x in letters]
    none = [None] * 8

    def row(i, freq, summary, ab, old, new):
        return (i, freq, *summary, *ab, *old, *new)

    df = spark.createDataFrame(
        [
            row(1, 2, (None, None, None, None), (1, 1), [1, 0, 0, 0, 0, 0, 0, 0], none),
            row(2, 7, (None, None, None, None), (0, 0), none, [0] * 8),
            row(3, None, (None, None, None, None), (0, 1), none, [1] + [0] * 7),
            row(4, 1, (3, 0, 2, 0), (1, None), none, [1, 1, 0, 0, 0, 0, 0, 0]),
            row(5, 2, (None, None, None, None), (0, None), [0] * 8, none),
        ],
        ", ".join(f"{c} int" for c in cols),
    )
    got = {
        r["id"]: tuple(r[c] for c in ("S56_24", "S56_24U", "S56_24X", "S56_24XV", "S56_24XL"))
        for r in D.harmonise_followup(df).collect()
    }
    assert got == {
        1: (2, 0, 1, 0, 1),  # oldest: extra items moved, counts derived
        2: (0, 9, 0, 9, 0),  # never searches: not asked
        3: (None, None, None, None, 1),  # frequency unknown: so are the summaries
        4: (3, 0, 2, 0, 1),  # newest: left alone
        5: (1, 1, 1, 1, 0),  # nothing ticked counts as "none of these"
    }


def test_chart_ids_follow_the_survey(spark, rows):
    labs = spark.createDataFrame(
        [
            ("WUSL", "7", 100, 1),
            ("WUSL", "12345", 100, 0),
            ("FRI", "F1", 200, 0),
            ("FRI", "F1", 100, 1),
            ("FRI", "F9", 100, 1),
            ("CBW", "7", 100, None),
            ("CBW", "8", 100, 0),
        ],
        "SiteID string, SiteSpecificID string, ServiceDate int, ViralSupp int",
    )
    xwalk = spark.createDataFrame([("F1", "P1")], "SiteSpecificID string, PID string")
    got = {tuple(r) for r in D.first_lab(labs, xwalk).collect()}
    assert got == {("WUSL", "0007", 1), ("WUSL", "12345", 0), ("FRI", "P1", 1), ("FRI", None, 1), ("CBW", "8", 0)}
