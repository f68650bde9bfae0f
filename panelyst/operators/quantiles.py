"""Exact order statistics and running totals without pulling a group into one task.

``percentile`` keeps every distinct value of a group in one buffer. Here the
rows are first collapsed to (variable, group, value, count) with a map-side combine.

* Quantiles are selected in rounds. While a range of a group holds many
  distinct values, splitters taken from its own values cut it into pieces, the
  pieces are counted, and only those that hold a position asked for go into the
  next round. What is left is small and is ranked. Any number of variables and
  groups take part in the same rounds.
* A running total is a prefix sum over range partitions: each task sums the
  values of its range in order, and the sums of earlier ranges are added.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelyst.sources.sinks import materialise

#: A range with more distinct values than this is cut, into so many pieces (a power of two).
SMALL, PIECES = 1 << 16, 64


def _local_sums(weight: str):
    """Batches of one sorted partition with ``cum``, the running sum of the weight in it."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        before = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cum = pc.cumulative_sum(batch.column(weight).cast(pa.int64()), start=before)
            before = cum[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, cum], [*batch.schema.names, "cum"])

    return run


def running_total(counts: DataFrame, value: str, weight: str) -> DataFrame:
    """Add ``cum``, the running sum of ``weight`` in order of ``value``, and ``total``.

    ``counts`` has one row per value, with whole weights that are not NULL. Its rows are sorted by ranges and
    written with their sums within the range; a number for each range is all that meets in one place.
    """
    ranged = counts.repartitionByRange(value).sortWithinPartitions(value)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema.fields), "cum long"])
    staged = materialise(ranged.mapInArrow(_local_sums(weight), schema).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = staged.groupBy("_part").agg(F.sum(weight).alias("_w"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("_part", F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_before"))
    offsets = before.agg(F.map_from_entries(F.collect_list(F.struct("_part", "_before")))).scalar()
    total = sums.agg(F.sum("_w")).scalar()
    placed = staged.withColumns({"_offsets": offsets, "total": total})
    return placed.withColumn("cum", F.col("cum") + F.element_at("_offsets", F.col("_part"))).drop("_offsets", "_part")


def _targets(probs: Sequence[float]) -> dict[str, Column]:
    """0-based positions of the two order statistics and the weight between them."""
    out = {}
    for i, p in enumerate(probs, 1):
        at = (F.col("total") - 1) * F.lit(float(p))
        out[f"_lo{i}"] = F.floor(at)
        out[f"_fr{i}"] = at - F.floor(at)
    return out


def _holds_any(start: Column, end: Column, probs: Sequence[float]) -> Column:
    """Whether one of the positions asked for lies in [start, end)."""
    out = F.lit(False)
    for i, _ in enumerate(probs, 1):
        low = F.col(f"_lo{i}")
        for place in (low, F.least(low + 1, F.col("total") - 1)):
            out = out | ((start <= place) & (place < end))
    return out


def _picked(ranked: DataFrame, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """``n`` and ``q1, q2, ...`` of each key from rows of ``_v``, ``_n``, ``cum`` and ``total``.

    A value covers the 0-based positions [cum - n, cum).
    """
    ranked = ranked.withColumns(_targets(probs))
    start, end = F.col("cum") - F.col("_n"), F.col("cum")
    picks = [F.max("total").alias("n")]
    for i, _ in enumerate(probs, 1):
        low = F.col(f"_lo{i}")
        ends = [F.max(F.when((start <= at) & (at < end), F.col("_v"))) for at in (low, F.least(low + 1, F.col("total") - 1))]
        picks.append((ends[0] + (ends[1] - ends[0]) * F.max(F.col(f"_fr{i}"))).alias(f"q{i}"))
    return ranked.where(_holds_any(start, end, probs)).groupBy(*keys).agg(*picks)


def _matched(left: DataFrame, right: DataFrame, keys: Sequence[str], add: Sequence[str]) -> DataFrame:
    """``left`` with columns ``add`` of the rows of ``right`` that have its keys, NULL keys included."""
    same = reduce(lambda a, b: a & b, (F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys))
    return left.alias("l").join(right.alias("r"), same).select("l.*", *[f"r.{c}" for c in add])


def _narrowed(rows: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """The pieces of each range that hold a position asked for, cut at splitters from the values of the range."""
    of = [*keys, "_range"]
    shares = F.array(*[F.lit(i / PIECES) for i in range(1, PIECES)])
    splitters = rows.groupBy(*of).agg(F.percentile_approx("_v", shares, 16 * PIECES).alias("_cuts"))
    cut = _matched(rows, splitters, of, ["_cuts"]).withColumn("_piece", F.lit(0))
    step = PIECES // 2
    while step:  # the number of cuts below the value, by binary search
        ahead = F.col("_piece") + step
        cut = cut.withColumn("_piece", F.when(F.col("_v") > F.element_at("_cuts", ahead), ahead).otherwise(F.col("_piece")))
        step //= 2
    cut = materialise(cut.drop("_cuts"), "pieces")
    in_range = W.partitionBy(*of)
    counted = cut.groupBy(*of, "_piece").agg(F.sum("_n").alias("_w"), F.max("_before").alias("_before"), F.max("total").alias("total"))
    start = F.col("_before") + F.sum("_w").over(in_range.orderBy("_piece")) - F.col("_w")
    wanted = (
        counted.withColumns(_targets(probs))
        .withColumn("_start", start)
        .where(_holds_any(F.col("_start"), F.col("_start") + F.col("_w"), probs))
        .select(*of, "_piece", "_start")
    )
    kept = _matched(cut, wanted, [*of, "_piece"], ["_start"])
    onward = kept.withColumns({"_before": F.col("_start"), "_range": F.col("_range") * PIECES + F.col("_piece")})
    return onward.select(*keys, "_range", "_before", "total", "_v", "_n")


def quantiles_of_many(
    df: DataFrame, values: Sequence[str], probs: Sequence[float], groups: Sequence[str] = (), overall: bool = False
) -> DataFrame:
    """Linearly interpolated quantiles ``q1, q2, ...`` and ``n`` per ``variable`` and group, from one scan of ``df``.

    With ``overall`` the group columns become NULL on one extra row per variable, marked by ``is_overall`` = 1, that
    is taken over all rows. A variable that is NULL throughout has no rows.
    """
    groups = list(groups)
    cells = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("_v")) for v in values])
    counts = (
        df.select(*groups, F.inline(cells))
        .where(F.col("_v").isNotNull())
        .groupBy("variable", *groups, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    keys = ["variable", *groups]
    if overall:
        everyone = counts.groupBy("variable", "_v").agg(F.sum("_n").alias("_n"))
        counts = counts.withColumn("is_overall", F.lit(0)).unionByName(
            everyone.withColumn("is_overall", F.lit(1)), allowMissingColumns=True
        )
        keys = [*keys, "is_overall"]
    counts = materialise(counts, "values")
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("total"), F.count(F.lit(1)).alias("_size"))
    sizes = materialise(sizes, "sizes")
    rows = _matched(counts, sizes, keys, ["total"]).withColumns({"_range": F.lit(0).cast("long"), "_before": F.lit(0).cast("long")})
    largest = sizes.agg(F.max("_size")).first()[0] or 0
    while largest > SMALL:
        rows = materialise(_narrowed(rows, keys, probs), "narrowed")
        smaller = rows.groupBy(*keys, "_range").count().agg(F.max("count")).first()[0]
        if smaller >= largest:
            break  # values that no splitter parts, such as NaN beside one other; ranking them is right all the same
        largest = smaller
    within = W.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    return _picked(rows.withColumn("cum", F.col("_before") + F.sum("_n").over(within)), probs, keys)


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], groups: Sequence[str] = (), overall: bool = False
) -> DataFrame:
    """:func:`quantiles_of_many` of one variable, without its name."""
    return quantiles_of_many(df, [value], probs, groups, overall).drop("variable")


def median(df: DataFrame, value: str) -> DataFrame:
    """``n`` and the median ``q1`` of one variable over all rows, by a running total of its values."""
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull()).groupBy(v.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return _picked(running_total(counts, "_v", "_n"), [0.5])


def approx_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    groups: Sequence[str] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """One-pass approximate quantiles, rank error at most n / accuracy."""
    arr = F.percentile_approx(F.col(value).cast("double"), list(probs), accuracy)
    out = df.groupBy(*groups).agg(F.count(value).alias("n"), arr.alias("_q"))
    return out.select(
        *groups, "n", *[F.col("_q")[i].alias(f"q{i + 1}") for i in range(len(probs))]
    )
