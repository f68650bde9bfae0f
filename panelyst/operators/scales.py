"""Scoring multi-item scales and their reliability."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyst.functions.nulls import null_count, row_sum
from panelyst.operators.clean import above_to_null, remap


@dataclass(frozen=True)
class Scale:
    """A scale: its items, their valid range and what missing answers do.

    ``skip_null`` False makes the score NULL when any item is missing.
    ``all_missing`` is the score of a battery without any answer.
    """

    name: str
    items: tuple[str, ...]
    max_valid: int
    label: str = ""
    reverse: dict[str, int] = field(default_factory=dict)
    remap: dict[int, int] = field(default_factory=dict)
    skip_null: bool = True
    all_missing: int | None = None


def clean_item(scale: Scale, item: str) -> Column:
    """Remap, then blank out-of-range codes, then reverse (``high - x``)."""
    c = above_to_null(remap(item, scale.remap), scale.max_valid)
    return F.lit(scale.reverse[item]) - c if item in scale.reverse else c


def cleaned(scales: Sequence[Scale], suffix: str = "_RC") -> dict[str, Column]:
    """Cleaned items of all scales by name.

    Scales may share an item only if they clean it alike, as its cleaned form has
    one name.
    """
    rules: dict[str, tuple] = {}
    for s in scales:
        for i in s.items:
            rule = (s.max_valid, s.remap, s.reverse.get(i))
            if rules.setdefault(i, rule) != rule:
                raise ValueError(f"item {i!r} is cleaned in two ways; use different suffixes")
    return {i + suffix: clean_item(s, i) for s in scales for i in s.items}


def clean_items(df: DataFrame, scales: Sequence[Scale], suffix: str = "_RC") -> DataFrame:
    """Add the cleaned items of all scales in one projection."""
    return df.withColumns(cleaned(scales, suffix))


def score(scale: Scale, suffix: str = "_RC") -> Column:
    """Sum of the cleaned items under the scale's missing-answer policy."""
    items = [i + suffix for i in scale.items]
    out = F.when(null_count(items) < len(items), row_sum(items, scale.skip_null))
    return out if scale.all_missing is None else out.otherwise(F.lit(scale.all_missing))


def score_scales(df: DataFrame, scales: Sequence[Scale], suffix: str = "_RC") -> DataFrame:
    """Cleaned items and scores of all scales: two projections, no shuffle."""
    return clean_items(df, scales, suffix).withColumns({s.name: score(s, suffix) for s in scales})


def _pair_sums(widths: list[int]):
    """Arrow batches of item columns to sums over each pair of items of a scale.

    For items i and j, over the rows where both are answered: ``n`` rows, ``si`` and
    ``sj`` the sums and ``p`` the sum of products. Three small matrix products per
    scale and batch; whole-number answers add up exactly.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns]
            out = {k: [] for k in ("scale", "i", "j", "n", "si", "sj", "p")}
            at = 0
            for scale, k in enumerate(widths):
                x = np.column_stack(cols[at : at + k])
                at += k
                known = ~np.isnan(x)
                x = np.where(known, x, 0.0)
                known = known.astype("float64")
                s = x.T @ known
                out["scale"].append(np.full(k * k, scale))
                out["i"].append(np.repeat(np.arange(k), k))
                out["j"].append(np.tile(np.arange(k), k))
                out["n"].append((known.T @ known).ravel())
                out["si"].append(s.ravel())
                out["sj"].append(s.T.ravel())
                out["p"].append((x.T @ x).ravel())
            yield pa.RecordBatch.from_pydict({k: np.concatenate(v) for k, v in out.items()})

    return run


def cronbach_alpha(df: DataFrame, scales: Sequence[Scale], suffix: str = "_RC", raw: bool = False) -> DataFrame:
    """Raw alpha per scale from pairwise-complete covariances, all in one pass.

    With ``raw`` the items of ``df`` are cleaned here, for each scale by its own rules, so that scales which
    treat an item differently share the pass.

    Hundreds of covariance aggregates side by side are too wide for generated
    code, so each task reduces its batches to pair sums and Spark adds those up: k
    squared short rows per batch and scale are all that is shuffled.
    """
    items = [i + suffix for s in scales for i in s.items]
    found = [cleaned([s])[i + suffix] if raw else F.col(i + suffix) for s in scales for i in s.items]
    columns = df.select(*[c.cast("double").alias(f"c{at}") for at, c in enumerate(found)])
    sums = (
        columns.mapInArrow(
            _pair_sums([len(s.items) for s in scales]),
            "scale long, i long, j long, n double, si double, sj double, p double",
        )
        .groupBy("scale", "i", "j")
        .agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "p")])
    )
    cov = F.try_divide(
        F.col("p") - F.try_divide(F.col("si") * F.col("sj"), F.col("n")),
        F.when(F.col("n") > 1, F.col("n") - 1),
    )
    totals = sums.groupBy("scale").agg(
        F.sum(cov).alias("total"), F.sum(F.when(F.col("i") == F.col("j"), cov)).alias("own"),
        F.count_if(cov.isNull()).alias("unknown"),
    )
    about = df.sparkSession.createDataFrame(
        [
            (at, s.label or s.name, len(s.items), ", ".join(i + suffix for i in s.items))
            for at, s in enumerate(scales)
        ],
        "scale long, label string, n_items int, items string",
    )
    k = F.col("n_items")
    alpha = F.try_divide(k, k - 1) * (1 - F.try_divide(F.col("own"), F.col("total")))
    return (
        about.join(totals, "scale", "left")
        .select(
            F.col("label").alias("scale"),
            F.when(F.col("unknown") == 0, alpha).alias("alpha"),
            "n_items",
            "items",
        )
    )
