"""Counts and shares per group.

Group totals reach the rows by an aggregate and an equi-join, not by a window over
the group: the aggregate combines map side, so a group that holds most of the
rows never has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyst.functions.nulls import agg_any
from panelyst.functions.scalars import ratio


def _same(left: DataFrame, right: DataFrame, groups: Sequence[str]) -> Column:
    cond = F.lit(True)
    for g in groups:
        cond = cond & left[g].eqNullSafe(right[f"_{g}"])
    return cond


def with_group_value(df: DataFrame, groups: Sequence[str], **aggs: Column) -> DataFrame:
    """Add aggregates of a row's group to the row; NULL is a group of its own."""
    per_group = df.groupBy(*groups).agg(*[c.alias(k) for k, c in aggs.items()])
    per_group = per_group.withColumnsRenamed({g: f"_{g}" for g in groups})
    return df.join(per_group, _same(df, per_group, groups), "left").drop(*[f"_{g}" for g in groups])


def share_of_group(df: DataFrame, n: str, groups: Sequence[str], out: str = "share") -> DataFrame:
    """Share of each row's count in its group's total."""
    with_total = with_group_value(df, groups, _total=F.sum(n))
    return with_total.withColumn(out, ratio(n, "_total")).drop("_total")


def group_max(df: DataFrame, value: str, groups: Sequence[str], out: str) -> DataFrame:
    return with_group_value(df, groups, **{out: F.max(value)})


def frequency(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Counts per combination of levels; rows with a NULL among them are left out."""
    return df.dropna("any", subset=list(cols)).groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def crosstab(df: DataFrame, row: str, col: str, row_levels: Sequence[str], col_levels: Sequence[str]) -> DataFrame:
    """Two-way counts over explicit level lists, empty cells as 0.

    The grid is written out from the two lists; the data are only counted.
    """
    counts = frequency(df.select(F.col(row).cast("string").alias("row"), F.col(col).cast("string").alias("col")), ["row", "col"])
    cells = [F.struct(F.lit(r).alias("row"), F.lit(c).alias("col")) for r in row_levels for c in col_levels]
    grid = df.sparkSession.range(1).select(F.inline(F.array(*cells)))
    return grid.join(counts, ["row", "col"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def overall_and_by_group(df: DataFrame, group: str, **aggs: Column) -> DataFrame:
    """Any aggregates, per group and over everyone, by grouping sets.

    ``is_overall`` tells the total row from the group of missing values.
    """
    return (
        df.groupingSets([[F.col(group)], []], F.col(group))
        .agg(F.grouping(group).cast("int").alias("is_overall"), *[c.alias(k) for k, c in aggs.items()])
    )


def conditional_counts(df: DataFrame, conditions: Mapping[str, Column], groups: Sequence[str] = ()) -> DataFrame:
    """Rows, and rows meeting each condition, in one pass."""
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()]
    )


def any_true(df: DataFrame, keys: Sequence[str], cond: Column, out: str = "any") -> DataFrame:
    """Per key: 1 if any row is true, else NULL if any is unknown, else 0."""
    return df.groupBy(*keys).agg(agg_any(cond).alias(out))


def distinct_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()
