"""How many respondents said yes, by item, category and group.

The question catalog is configuration, so its labels are written into the
result rows directly and no join is needed. Each function is one aggregate
over the table with one wide row per group, turned into long rows afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyst.functions.nulls import any_of
from panelyst.functions.scalars import positive, ratio

ANY_TOPIC = "Any of these"


@dataclass(frozen=True)
class Question:
    """One item: ``facet`` is its timeframe or platform; ``in_any`` whether it
    counts towards its category as a whole."""

    variable: str
    category: str
    topic: str
    facet: str
    in_any: bool = True


def _cells_to_rows(summary: DataFrame, groups: Sequence[str], cells: list[Column]) -> DataFrame:
    long = summary.select(*groups, F.inline(F.array(*cells)))
    return long.withColumn("proportion", ratio("n", "total", 3))


def _categories(questions: Sequence[Question]) -> dict[tuple[str, str], list[str]]:
    out: dict[tuple[str, str], list[str]] = {}
    for q in questions:
        if q.in_any:
            out.setdefault((q.category, q.facet), []).append(q.variable)
    return out


def _cell(variable, category, topic, facet, n: Column, total: Column) -> Column:
    return F.struct(
        F.lit(variable).alias("variable"),
        F.lit(category).alias("category"),
        F.lit(topic).alias("topic"),
        F.lit(facet).alias("facet"),
        n.alias("n"),
        total.alias("total"),
    )


def item_prevalence(
    df: DataFrame,
    questions: Sequence[Question],
    groups: Sequence[str] = (),
    denominator: str = "max_answered",
    any_rows: bool = True,
) -> DataFrame:
    """Yes-count, total and proportion per item, and per category as a whole.

    ``denominator``: ``max_answered`` (most answers any item got in the group),
    ``answered`` (answers to this item) or ``rows``. Category rows count a person
    once if any known item is 1, over all rows of the group.
    """
    if denominator not in ("max_answered", "answered", "rows"):
        raise ValueError(f"unknown denominator {denominator!r}")
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, q in enumerate(questions):
        aggs.append(F.count_if(F.col(q.variable) == 1).alias(f"y{i}"))
        if denominator != "rows":
            aggs.append(F.count(q.variable).alias(f"a{i}"))
    cats = _categories(questions) if any_rows else {}
    for j, items in enumerate(cats.values()):
        aggs.append(F.count_if(any_of([F.col(v) == 1 for v in items])).alias(f"c{j}"))
    answered = [F.col(f"a{i}") for i in range(len(questions))]
    if denominator == "rows":
        totals = [F.col("_rows")] * len(questions)
    elif denominator == "answered":
        totals = answered
    else:
        totals = [F.greatest(*answered) if len(answered) > 1 else answered[0]] * len(questions)
    cells = [
        _cell(
            q.variable,
            q.category,
            q.topic,
            q.facet,
            F.col(f"y{i}"),
            totals[i],
        )
        for i, q in enumerate(questions)
    ]
    cells += [
        _cell(f"{cat} / {facet}", cat, ANY_TOPIC, facet, F.col(f"c{j}"), F.col("_rows"))
        for j, (cat, facet) in enumerate(cats)
    ]
    return _cells_to_rows(df.groupBy(*groups).agg(*aggs), groups, cells)


def category_indicators(questions: Sequence[Question]) -> dict[tuple[str, str], Column]:
    """1 if any item of the category is 1, 0 if none, NULL if any is missing."""
    return {
        key: (reduce(add, [positive(v) for v in items]) > 0).cast("int")
        for key, items in _categories(questions).items()
    }


def category_prevalence(
    df: DataFrame, questions: Sequence[Question], groups: Sequence[str] = ()
) -> DataFrame:
    """Prevalence of the category indicators among rows with all items answered."""
    inds = category_indicators(questions)
    aggs = []
    for j, c in enumerate(inds.values()):
        aggs += [F.count_if(c == 1).alias(f"y{j}"), F.count(c).alias(f"a{j}")]
    cells = [
        F.struct(
            F.lit(f"{cat} / {facet}").alias("variable"),
            F.lit(cat).alias("category"),
            F.lit(facet).alias("facet"),
            F.col(f"y{j}").alias("n"),
            F.col(f"a{j}").alias("total"),
        )
        for j, (cat, facet) in enumerate(inds)
    ]
    return _cells_to_rows(df.groupBy(*groups).agg(*aggs), groups, cells)
