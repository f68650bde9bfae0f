"""Choosing, naming and mapping over columns.

Name lists are resolved from the schema alone; only the two data-dependent
drops at the end run a job, one aggregate each.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def starting_with(df: DataFrame, *prefixes: str) -> list[str]:
    """Names with one of the prefixes, ignoring case."""
    low = tuple(p.lower() for p in prefixes)
    return [c for c in df.columns if c.lower().startswith(low)]


def containing(df: DataFrame, *parts: str) -> list[str]:
    """Names containing one of the texts, ignoring case."""
    return [c for c in df.columns if any(p.lower() in c.lower() for p in parts)]


def matching(df: DataFrame, pattern: str) -> list[str]:
    """Names in which the regex occurs, ignoring case."""
    rx = re.compile(pattern, re.IGNORECASE)
    return [c for c in df.columns if rx.search(c)]


def between(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in schema order, both included."""
    cols = df.columns
    return cols[cols.index(first) : cols.index(last) + 1]


def existing(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Those of ``names`` the table has, in the order asked for."""
    have = set(df.columns)
    return [n for n in names if n in have]


def numbered(prefix: str, numbers: Iterable[int], width: int = 0, suffix: str = "") -> list[str]:
    """Generated names such as ``HE01 .. HE04``."""
    return [f"{prefix}{n:0{width}d}{suffix}" for n in numbers]


def shared(left: DataFrame, right: DataFrame | Sequence[str]) -> list[str]:
    """Names both sides have, in the left order."""
    names = set(right.columns if isinstance(right, DataFrame) else right)
    return [c for c in left.columns if c in names]


def keep_shared(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.select(shared(df, other))


def drop_between(df: DataFrame, first: str, last: str) -> DataFrame:
    return df.drop(*between(df, first, last))


def key_first(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[c for c in df.columns if c not in keys])


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def map_columns(
    df: DataFrame, cols: Iterable[str], fn: Callable[[Column], Column], suffix: str = ""
) -> DataFrame:
    """Apply one column function to many columns in a single projection."""
    return df.withColumns({c + suffix: fn(F.col(c)) for c in cols})


def summarise_columns(
    df: DataFrame,
    cols: Sequence[str],
    fn: Callable[[Column], Column],
    groups: Sequence[str] = (),
) -> DataFrame:
    """Apply one aggregate to many columns; one row per group."""
    return df.groupBy(*groups).agg(*[fn(F.col(c)).alias(c) for c in cols])


def to_long(df: DataFrame, keys: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long: one row per (row, column)."""
    return df.unpivot(list(keys), list(cols), name, value)


def to_wide(df: DataFrame, keys: Sequence[str], name: str, value: str, levels: Sequence) -> DataFrame:
    """Long to wide over an explicit level list, so no job is needed to find it."""
    return df.groupBy(*keys).pivot(name, list(levels)).agg(F.first(value, ignorenulls=True))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(variable, n_null, n_rows)`` in one pass; only the single result row is unpivoted."""
    cols = list(cols or df.columns)
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in cols]
    )
    cells = [
        F.struct(
            F.lit(c).alias("variable"),
            (F.col("_rows") - F.col(f"`{c}`")).alias("n_null"),
            F.col("_rows").alias("n_rows"),
        )
        for c in cols
    ]
    return row.select(F.inline(F.array(*cells)))


def all_null_columns(df: DataFrame) -> list[str]:
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if counts[c] == 0]


def drop_all_null(df: DataFrame) -> DataFrame:
    """Drop the columns that hold no value at all (one aggregate job)."""
    return df.drop(*all_null_columns(df))


def all_zero_columns(df: DataFrame) -> list[str]:
    numeric = [
        f.name
        for f in df.schema.fields
        if f.dataType.typeName() in {"byte", "short", "integer", "long", "float", "double", "decimal"}
    ]
    if not numeric:
        return []
    row = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c) == 0).alias(c) for c in numeric]
    ).first()
    return [c for c in numeric if row[c] == row["_rows"]]


def drop_all_zero(df: DataFrame) -> DataFrame:
    """Drop the columns that are 0 on every row; a NULL anywhere keeps the column."""
    return df.drop(*all_zero_columns(df))
