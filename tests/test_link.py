from __future__ import annotations

import datetime

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from panelyst.operators import link as L

KEYS = ["site", "pid"]


def waves(spark):
    base = spark.createDataFrame([(1, "a", 10), (1, "b", 20), (2, "a", 30)], "site int, pid string, x int")
    follow = spark.createDataFrame([(1, "a", 7), (3, "z", 8)], "site int, pid string, y int")
    return base, follow


def test_link_partitions_the_baseline(spark, rows):
    base, follow = waves(spark)
    linked = L.link_waves(base, follow, KEYS)
    assert rows(linked, "site", "pid", "y", "Set") == [(1, "a", 7, 1), (1, "b", None, 0), (2, "a", None, 0)]
    assert rows(linked.where("Set = 1"), "site", "pid") == rows(L.retained(base, follow, KEYS), "site", "pid")
    assert rows(linked.where("Set = 0"), "site", "pid") == rows(L.lost(base, follow, KEYS), "site", "pid")
    assert rows(L.orphans(follow, base, KEYS)) == [(3, "z", 8)]
    assert rows(L.key_overlap(base, follow, KEYS)) == [(1, "a")]


def test_duplicate_followup_is_refused(spark):
    base, follow = waves(spark)
    with pytest.raises(Exception, match="not unique, for example"):
        L.link_waves(base, follow.union(follow), KEYS).collect()


def test_keys_are_checked_in_the_run_itself(spark):
    """No job before the run, and with an observation the repeated rows are told after it."""
    base, follow = waves(spark)
    spark.sparkContext.setJobGroup("checked", "link")
    linked = L.link_waves(base, follow, KEYS)
    tracker = spark.sparkContext.statusTracker()
    assert len(tracker.getJobIdsForGroup("checked")) == 0
    spark.sparkContext.setJobGroup("other", "other")
    assert linked.count() == 3
    watch = Observation("keys")
    assert L.require_unique(follow.union(follow.where("pid = 'a'")), KEYS, watch).count() == 3
    assert watch.get == {"repeated": 2}


def test_null_keys(spark):
    base = spark.createDataFrame([(None, "a", 1)], "site int, pid string, x int")
    follow = spark.createDataFrame([(None, "a", 2)], "site int, pid string, y int")
    assert L.link_waves(base, follow, KEYS).first()["Set"] == 0
    assert L.link_waves(base, follow, KEYS, null_safe=True).first()["Set"] == 1


def test_rekey_touches_one_subgroup(spark, rows):
    df = spark.createDataFrame([("FRI", "1"), ("FRI", "2"), ("CBW", "1"), (None, "1")], "site string, local string")
    xwalk = spark.createDataFrame([("1", "P1")], "local string, pid string")
    out = L.rekey_subgroup(df, xwalk, F.col("site") == "FRI", "local", "pid", out="pid")
    assert out.columns == ["site", "pid"]
    assert {tuple(r) for r in out.collect()} == {("FRI", "P1"), ("FRI", None), ("CBW", "1"), (None, "1")}


def test_first_value_by_date(spark, rows):
    d = datetime.date
    df = spark.createDataFrame(
        [
            ("a", None, d(2018, 1, 1), 1),
            ("a", 1, d(2018, 1, 3), 2),
            ("a", 0, d(2018, 1, 2), 4),
            ("a", 1, d(2018, 1, 2), 3),
            ("b", 1, None, 1),
            ("b", 0, d(2019, 1, 1), 2),
            ("c", None, d(2019, 1, 1), 1),
        ],
        "k string, v int, day date, seq int",
    )
    # Ties by seq; a missing date loses to any date; a key without values is absent.
    assert rows(L.first_value_by_date(df, ["k"], "v", "day", ["seq"])) == [("a", 1), ("b", 0)]


@pytest.mark.parametrize(
    "days, expected",
    [([0], 1), ([183], 1), ([184], 0), ([-1], 0), ([184, 10], 1), ([None], None), ([500, None], None), ([], None)],
)
def test_visit_window(spark, days, expected):
    index = spark.createDataFrame([("a", datetime.date(2018, 7, 1))], "k string, today date")
    visits = spark.createDataFrame(
        [("a", None if n is None else datetime.date(2018, 7, 1) - datetime.timedelta(days=n)) for n in days],
        "k string, day date",
    )
    assert L.visit_in_window(index, visits, ["k"], "today", "day").first()["visited"] == expected


def test_visit_window_without_index_date(spark):
    index = spark.createDataFrame([("a", None)], "k string, today date")
    visits = spark.createDataFrame([("a", datetime.date(2018, 7, 1))], "k string, day date")
    assert L.visit_in_window(index, visits, ["k"], "today", "day").first()["visited"] is None


def test_visits_collapse_before_the_join(spark):
    """A key with most of the visits sends one row per day, not one per visit."""
    index = spark.createDataFrame([("a", datetime.date(2018, 7, 1))], "k string, today date")
    visits = spark.range(1000).select(
        (F.col("id") % 3).cast("string").alias("k"), F.lit("2018-06-01").cast("date").alias("day")
    )
    plan = L.visit_in_window(index, visits, ["k"], "today", "day")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Join") :]  # the visits' aggregate is below the join


def test_harmonise_versions(spark, rows):
    df = spark.createDataFrame([(1, 5, None), (2, None, 6), (3, None, None)], "id int, old int, new int")
    out = L.harmonise_versions(df, {"new": "old"}, F.col("old").isNotNull())
    assert out.columns == ["id", "new"]
    assert rows(out) == [(1, 5), (2, 6), (3, None)]


def test_stack_and_other_text(spark, rows):
    a = spark.createDataFrame([(1, "x")], "id int, t string")
    b = spark.createDataFrame([(2, 5)], "id int, n int")
    assert {tuple(r) for r in L.stack(a, b).collect()} == {(1, "x", None), (2, None, 5)}
    t = spark.createDataFrame([(1, "[Skipped]", "dog"), (2, None, "[Skipped]")], "id int, p string, q string")
    assert rows(L.other_text(t, ["id"], ["p", "q"])) == [(1, "q", "dog")]
