"""Predicates and row sums with the missing-value rules survey work expects.

A missing answer is SQL NULL. These helpers differ from the plain Spark
operators exactly where survey code wants another answer for NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def if_else(cond: Column, yes, no) -> Column:
    """Like ``when(cond, yes).otherwise(no)`` but a NULL condition gives NULL."""
    return F.when(cond, yes).when(~cond, no)


def indicator(cond: Column) -> Column:
    """1 where true, 0 where false, NULL where unknown."""
    return cond.cast("int")


def is_in(c: Column | str, values: Sequence) -> Column:
    """Membership that is never NULL: a missing value is in no set."""
    return F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def matches(c: Column | str, pattern: str) -> Column:
    """Regex search that is never NULL: a missing text matches nothing."""
    return F.coalesce(as_col(c).rlike(pattern), F.lit(False))


def null_count(cols: Sequence[Column | str]) -> Column:
    """Number of NULLs among the columns of a row."""
    return reduce(add, [as_col(c).isNull().cast("int") for c in cols])


def row_sum(cols: Sequence[Column | str], skip_null: bool = True) -> Column:
    """Sum across columns; NULLs count as zero, or make the sum NULL."""
    parts = [as_col(c) for c in cols]
    if skip_null:
        parts = [F.coalesce(c, F.lit(0)) for c in parts]
    return reduce(add, parts)


def any_equal(cols: Sequence[Column | str], value=1) -> Column:
    """Whether any column equals ``value``; NULL as soon as one column is NULL."""
    return row_sum([indicator(as_col(c) == value) for c in cols], skip_null=False) > 0


def any_of(conds: Sequence[Column]) -> Column:
    """Three-valued OR of many conditions."""
    return reduce(or_, conds)


def all_of(conds: Sequence[Column]) -> Column:
    """Three-valued AND of many conditions."""
    return reduce(and_, conds)


def all_in(cols: Sequence[Column | str], values: Sequence = (0, 1)) -> Column:
    """True only when every column holds one of ``values`` (NULL does not)."""
    return all_of([is_in(c, values) for c in cols])


def agg_any(cond: Column) -> Column:
    """Aggregate: 1 if any row is true, else NULL if any is unknown, else 0."""
    return (
        F.when(F.bool_or(cond), F.lit(1))
        .when(F.count_if(cond.isNull()) > 0, F.lit(None).cast("int"))
        .otherwise(F.lit(0))
    )


def agg_sum0(c: Column | str) -> Column:
    """Aggregate: sum that skips NULLs and is 0 for an all-NULL group."""
    return F.coalesce(F.sum(as_col(c)), F.lit(0))
