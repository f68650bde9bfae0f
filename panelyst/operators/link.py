"""Linking survey waves, chart extracts and lookups on composite keys.

All joins are equi-joins. No side is forced to be broadcast: Spark does so by
itself when the measured size is under its threshold, and otherwise shuffles,
splitting skewed partitions. Event tables are collapsed before they are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from panelyst.functions.nulls import agg_any, as_col
from panelyst.functions.scalars import WINDOW_DAYS, within_days


def _on(left: DataFrame, right: DataFrame, keys: Sequence[str], null_safe: bool):
    if not null_safe:
        return list(keys)
    cond = None
    for k in keys:
        same = left[k].eqNullSafe(right[k])
        cond = same if cond is None else cond & same
    return cond


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count; empty when unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str], watch: Observation | None = None) -> DataFrame:
    """The table, checked while it is read: the run that meets a key a second time fails.

    With ``watch`` it does not fail; ``watch.get["repeated"]`` tells after the run how many rows share their key. The
    check sorts by the keys, as a join on them does anyway, and runs no job of its own.
    """
    same = Window.partitionBy(*keys)
    counted = df.withColumn("_same", F.count(F.lit(1)).over(same))
    if watch is not None:
        return counted.observe(watch, F.count_if(F.col("_same") > 1).alias("repeated")).drop("_same")
    named = F.to_json(F.struct(*[F.col(k).cast("string").alias(k) for k in keys]))
    refusal = F.raise_error(F.concat(F.lit(f"keys {list(keys)} are not unique, for example "), named))
    return counted.where(F.when(F.col("_same") > 1, refusal.cast("boolean")).otherwise(True)).drop("_same")


def link_waves(
    baseline: DataFrame,
    followup: DataFrame,
    keys: Sequence[str],
    flag: str = "Set",
    validate: bool = True,
    null_safe: bool = False,
) -> DataFrame:
    """Baseline rows with their follow-up answers and a 1/0 retention flag.

    One left join stands for the retained and the lost rows together. Follow-up
    keys must be unique, or rows would multiply; ``validate`` checks that in the same run.
    """
    if validate:
        followup = require_unique(followup, keys)
    extra = [c for c in followup.columns if c not in baseline.columns]
    right = followup.select(*keys, *extra).withColumn("_hit", F.lit(1))
    joined = baseline.join(right, _on(baseline, right, keys, null_safe), "left")
    if null_safe:
        for k in keys:
            joined = joined.drop(right[k])
    return joined.withColumn(flag, F.coalesce("_hit", F.lit(0))).drop("_hit")


def retained(baseline: DataFrame, followup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows present in both waves, the follow-up columns attached."""
    extra = [c for c in followup.columns if c not in baseline.columns]
    return baseline.join(followup.select(*keys, *extra), list(keys), "inner")


def lost(baseline: DataFrame, followup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the first table whose key the second one lacks."""
    return baseline.join(followup.select(*keys), list(keys), "left_anti")


def orphans(followup: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Follow-up rows without a baseline."""
    return lost(followup, baseline, keys)


def key_overlap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the first table that also occur in the second (should be none for rejects)."""
    return left.join(right.select(*keys), list(keys), "left_semi").select(*keys)


def attach(df: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Add a lookup's columns: left keeps all rows, right all lookup rows, full both."""
    return df.join(lookup, list(keys), how)


def rekey_subgroup(
    df: DataFrame,
    xwalk: DataFrame,
    where: Column,
    id_col: str,
    new_id: str,
    out: str | None = None,
) -> DataFrame:
    """Replace the ids of one subgroup through a cross-walk; others keep theirs.

    An id of the subgroup that the cross-walk lacks becomes NULL, as in a left join.
    The membership flag is part of the join key: rows outside the subgroup match
    nothing and spread over the partitions by their own id.
    """
    out = out or id_col
    inside = F.coalesce(where, F.lit(False))
    look = xwalk.select(
        F.lit(True).alias("_in"),
        F.col(id_col).cast("string").alias("_id"),
        F.col(new_id).cast("string").alias("_new"),
    )
    keyed = df.withColumns({"_in": inside, "_id": F.col(id_col).cast("string")})
    joined = keyed.join(look, ["_in", "_id"], "left")
    return joined.withColumn(out, F.when(F.col("_in"), F.col("_new")).otherwise(F.col("_id"))).drop(
        "_in", "_id", "_new", *([id_col] if out != id_col else [])
    )


def first_value_by_date(
    df: DataFrame, keys: Sequence[str], value: str, date: str, tiebreak: Sequence[str] = (), out: str | None = None
) -> DataFrame:
    """Value at the earliest date per key; rows without a value are not considered.

    A map-side ``min_by``: each key sends one candidate per partition.
    """
    when = F.when(F.col(date).isNotNull(), F.struct(date, *tiebreak))
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.min_by(value, when).alias(out or value))
    )


def visit_in_window(
    index: DataFrame,
    visits: DataFrame,
    keys: Sequence[str],
    index_date: str,
    visit_date: str,
    days: int = WINDOW_DAYS,
    out: str = "visited",
) -> DataFrame:
    """Per index row: 1 if a visit fell in the window, 0 if not, NULL if unknown.

    No visit at all, or no index date, is unknown; so is a key whose only doubt
    is a visit without a date. Visits shrink to one row per key and day before
    the join, which also flattens a key that holds most of the visits.
    """
    per_day = visits.select(*keys, F.col(visit_date).cast("date").alias("_day")).distinct()
    joined = index.select(*keys, index_date).join(per_day, list(keys), "left")
    return joined.groupBy(*keys).agg(agg_any(within_days(index_date, "_day", days)).alias(out))


def harmonise_versions(
    df: DataFrame,
    pairs: dict[str, str],
    version: Column,
) -> DataFrame:
    """Move retired columns into their successors in one projection.

    ``pairs`` maps the new name to the retired one; ``version`` (true on rows of the
    old questionnaire) says where the old column is the valid one. Retired
    columns are dropped.
    """
    old = F.coalesce(version, F.lit(False))
    moved = {
        new: F.when(old, F.col(was)).otherwise(F.col(new) if new in df.columns else F.lit(None))
        for new, was in pairs.items()
    }
    return df.withColumns(moved).drop(*[was for was in pairs.values() if was not in pairs])


def stack(*tables: DataFrame) -> DataFrame:
    """Union by name; a column a table lacks is NULL there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def other_text(df: DataFrame, keys: Sequence[str], cols: Sequence[str], skipped: str = "[Skipped]") -> DataFrame:
    """Long table of free-text answers, without the skip marker."""
    long = df.select(*keys, *[as_col(c).cast("string").alias(c) for c in cols]).unpivot(
        list(keys), list(cols), "question", "answer"
    )
    return long.where(F.col("answer") != skipped)
