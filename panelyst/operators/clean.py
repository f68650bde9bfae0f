"""Cleaning: scrubbing tokens and sentinels, splitting off rejects, point fixes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyst.functions.nulls import all_in, as_col, is_in, matches, null_count
from panelyst.functions.scalars import pad_left

# The dot run that stands for "no answer", and the response
# levels that are left out of frequency tables.
DOT_RUN = r"\.{5}"
SPECIAL_LEVELS = ("Skipped", "Refuse to answer", "Missing")


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]


def token_to_null(df: DataFrame, pattern: str = DOT_RUN, cols: Sequence[str] | None = None) -> DataFrame:
    """Blank every text value in which the token occurs."""
    return df.withColumns(
        {c: F.when(~matches(c, pattern), F.col(c)) for c in (cols or string_columns(df))}
    )


def na_strings(df: DataFrame, tokens: Sequence[str] = ("", "NA"), cols: Sequence[str] | None = None) -> DataFrame:
    """Blank text values that equal one of the missing-value tokens."""
    return df.withColumns(
        {c: F.when(~is_in(c, tokens), F.col(c)) for c in (cols or string_columns(df))}
    )


def above_to_null(c: Column | str, max_valid) -> Column:
    """Codes above the valid range mean refused, skipped or unknown."""
    c = as_col(c)
    return F.when(c <= max_valid, c)


def sentinel_to_null(df: DataFrame, cols: Sequence[str], max_valid, suffix: str = "") -> DataFrame:
    return df.withColumns({c + suffix: above_to_null(c, max_valid) for c in cols})


def remap(c: Column | str, mapping: Mapping) -> Column:
    """Replace listed codes, keep the others."""
    c = as_col(c)
    out = c
    for old, new in mapping.items():
        out = F.when(c == old, F.lit(new)).otherwise(out)
    return out


def remap_then_scrub(
    df: DataFrame, cols: Sequence[str], mapping: Mapping, max_valid, suffix: str = ""
) -> DataFrame:
    """Remap first, then blank what is still out of range."""
    return df.withColumns({c + suffix: above_to_null(remap(c, mapping), max_valid) for c in cols})


def correct_where(df: DataFrame, col: str, value, where: Column) -> DataFrame:
    """Overwrite one column on the rows where the whole condition holds."""
    return df.withColumn(col, F.when(where, F.lit(value)).otherwise(F.col(col)))


def zero_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in cols})


def pad_subgroup(df: DataFrame, id_col: str, where: Column, width: int, fill: str = "0") -> DataFrame:
    """Left-pad the ids of one subgroup."""
    text = F.col(id_col).cast("string")
    return df.withColumn(
        id_col, F.when(F.coalesce(where, F.lit(False)), pad_left(id_col, width, fill)).otherwise(text)
    )


def override_from_text(df: DataFrame, item: str, text: str, pattern: str, value) -> DataFrame:
    """Set an item where the free text matches."""
    return df.withColumn(item, F.when(matches(text, pattern), F.lit(value)).otherwise(F.col(item)))


def reverse_code(c: Column | str, low: int, high: int) -> Column:
    return F.lit(low + high) - as_col(c)


def split_valid(df: DataFrame, invalid: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows and rejects; a row is a reject when ``invalid`` is true."""
    flag = F.coalesce(invalid, F.lit(False))
    return df.where(~flag), df.where(flag)


def binary_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows on which every listed column is 0 or 1."""
    return df.where(all_in(cols, (0, 1)))


def answered_rows(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """Rows with at least one of the items answered."""
    return df.where(null_count(items) < len(items))


def complete_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.dropna("any", subset=list(cols) if cols else None)


def without_levels(df: DataFrame, col: str, levels: Sequence[str] = SPECIAL_LEVELS) -> DataFrame:
    """Drop rows at special response levels; NULL rows stay."""
    return df.where(~is_in(col, levels))
