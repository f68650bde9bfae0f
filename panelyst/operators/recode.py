"""Recoding answers and deriving indicator variables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyst.functions.nulls import all_of, any_of, as_col, if_else, indicator, is_in, matches
from panelyst.operators.quantiles import median


def recode(c: Column | str, mapping: Mapping) -> Column:
    """Code to label, many to one. Unlisted codes keep their text, NULL stays NULL."""
    c = as_col(c).cast("string")
    table = F.create_map(*chain.from_iterable((F.lit(str(k)), F.lit(v)) for k, v in mapping.items()))
    return F.coalesce(F.try_element_at(table, c), c)


def override(recoded: Column | str, base: Column | str) -> Column:
    """An adjudicated recode wins over the base label."""
    return F.coalesce(as_col(recoded), as_col(base))


def ladder(rules: Sequence[tuple[Column, object]], default=None) -> Column:
    """First rule that is true decides; a rule that is unknown is passed over."""
    out = None
    for cond, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    if default is None:
        return out
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def dummies(
    c: Column | str,
    prefix: str,
    levels: Mapping[str, str | tuple[str, ...]],
    reference: str | None = None,
) -> dict[str, Column]:
    """0/1 columns, one per level; the reference level is marked ``RCR``, the rest ``RCD``.

    ``levels`` maps the name suffix to the level or levels. A NULL input gives NULL
    dummies.
    """
    c = as_col(c)
    return {
        f"{prefix}_{'RCR' if key == reference else 'RCD'}_{key}": indicator(
            c.isin(list(level)) if isinstance(level, tuple) else c == level
        )
        for key, level in levels.items()
    }


def multi_select(
    boxes: Sequence[Column | str], text: Column | str | None = None, pattern: str | None = None
) -> Column:
    """1 if any check-box is ticked or the adjudicated text matches."""
    conds = [as_col(b) == 1 for b in boxes]
    if text is not None:
        conds.append(matches(text, pattern))
    return indicator(any_of(conds))


def none_of(flags: Sequence[Column | str]) -> Column:
    """1 if all flags are 0."""
    return indicator(all_of([as_col(f) == 0 for f in flags]))


def complement(flag: Column | str) -> Column:
    return if_else(as_col(flag) == 1, F.lit(0), F.lit(1))


def not_among(c: Column | str, values: Sequence) -> Column:
    """1 when the answer is missing or not one of the valid codes."""
    return indicator(~is_in(c, values))


SPLIT_LABELS = ("Zero", "Low", "High", "Don't know")


def non_zero_median(df: DataFrame, value: str) -> Column:
    """Exact median of the non-zero values, as a scalar subquery."""
    return median(df.where(F.col(value) != 0), value).select("q1").scalar()


def split_at(c: Column | str, cut: Column, labels: Sequence[str] = SPLIT_LABELS) -> Column:
    """Zero / below / at-or-above the cut / unknown."""
    c = as_col(c)
    zero, low, high, unknown = labels
    return ladder([(c.isNull(), unknown), (c == 0, zero), ((c > 0) & (c < cut), low), (c >= cut, high)])


def median_split(
    df: DataFrame, value: str, out: str, labels: Sequence[str] = SPLIT_LABELS, source: DataFrame | None = None
) -> DataFrame:
    """Split at the median of the non-zero values.

    The median reaches the rows as a scalar subquery, so the table itself is
    neither shuffled nor joined. ``source`` may name a cheaper table with the
    same values, such as the one ``df`` was joined from.
    """
    cut = non_zero_median(df if source is None else source, value)
    return df.withColumn(out, split_at(value, cut, labels))


def band(c: Column | str, edges: Sequence, labels: Sequence[str]) -> Column:
    """Label by ascending cut points; the last band has no upper bound."""
    c = as_col(c)
    rules = [(c < e, lab) for e, lab in zip(edges, labels)]
    return ladder([*rules, (c >= edges[-1], labels[-1])])


def years_since_event(
    as_of: Column | str, event_year: Column | str, special: int, fallback: Column | str
) -> Column:
    """Years from the event to the survey; a special code means the fallback."""
    year = as_col(event_year)
    return ladder(
        [
            (year != special, F.year(as_col(as_of)) - year),
            (year == special, as_col(fallback)),
        ]
    )


def same_year(event_year: Column | str, birth_year: Column | str) -> Column:
    """1 if the event fell in the birth year, 0 if not, NULL if either is unknown."""
    return indicator(as_col(event_year) == as_col(birth_year))
