"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words. A document is to be taken target / source size times, which is
seldom a whole number: the whole part is taken, and the fractional parts are settled in pairs. A random amount
of words moves from one document of a pair to the other until one of the two is taken a whole number of times;
the other goes on to the next pair. What a pair holds together never changes, so the words of a source keep to
its target but for the last document, and each document is taken its share of times on average.

Pairs are made within buckets of a source of bounded size; the one document that each bucket leaves over goes
to a bucket of the next level, and so on as in a reduction tree. The last bucket of a source settles all.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyst.sources.sinks import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: Documents settled in one group; the fan-in of the reduction tree.
BUCKET = 2048
#: Equal rows that are numbered in one run.
RUN = 1 << 16
ROUNDED = "doc_id long, sid long, size long, tie long, nth long, whole int, part double, level int, settled boolean"


def word_count(text: Column) -> Column:
    """Words of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(sources: DataFrame, column: str) -> DataFrame:
    """Adds ``sid``: 0, 1, ... in the order of ``column`` by code point, NULL last, without one task for all."""
    ranged = sources.repartitionByRange(F.col(column).asc_nulls_last()).withColumn("pid", F.spark_partition_id())
    ranged = materialise(ranged, "ranged")
    before, at = {}, 0
    for pid, n in sorted(ranged.groupBy("pid").count().collect()):  # one row for each partition
        before[pid], at = at, at + n
    first = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("pid").orderBy(F.col(column).asc_nulls_last()))
    return ranged.withColumn("sid", (first[F.col("pid")] + inside - 1).cast("long")).drop("pid")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, sid, source_size, documents, target) from one row for each source with its size and documents.

    ``weights`` are dealt to the sources in order, again and again. A target above ``most`` times the size stops
    there; the excess is shared out by weight again. Only sums of the table reach the driver.
    """
    weight = F.lit(None).cast("long")
    for k, w in enumerate(weights):
        weight = F.when(F.col("sid") % len(weights) == k, F.lit(w).cast("long")).otherwise(weight)
    table = materialise(numbered(sizes, "source").withColumn("weight", weight), "sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * most
    capped_words, level = 0, None
    free = table.agg(F.sum("weight")).first()[0] or 0
    while free:
        level = (total - capped_words) / free
        above = cap < F.col("weight") * F.lit(level)
        full, rest = table.agg(
            F.sum(F.when(above, cap).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))
        ).first()
        if full == capped_words and rest == free:
            break
        capped_words, free = full, rest
    target = cap.cast("double") if not free else F.least(cap.cast("double"), F.col("weight") * F.lit(level))
    return table.withColumn("target", target).drop("weight")


def settle(size: np.ndarray, part: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int | None]:
    """Pivotal rounding of fractional copies, all words kept: (part of each, index of the one left over).

    ``part`` is in [0, 1); the result is 0 or 1 for all but the one left over.
    """
    mass = part * size
    out = np.where(size > 0, part, 0.0)
    draws = rng.random(len(size))
    held: int | None = None
    a = 0.0
    for j in range(len(size)):
        if not 0.0 < out[j] < 1.0:
            continue
        if held is None:
            held, a = j, mass[j]
            continue
        b, room, other = mass[j], size[held] - a, size[j] - mass[j]
        up, down = min(room, b), min(a, other)
        if draws[j] * (up + down) < down:  # the held one gains
            if up == room:
                out[held], held, a = 1.0, j, b - up
                if a <= 0.0:
                    out[j], held = 0.0, None
            else:
                out[j], a = 0.0, a + up
        elif down == a:
            out[held], held, a = 0.0, j, b + down
            if a >= size[j]:
                out[j], held = 1.0, None
        else:
            out[j], a = 1.0, a - down
    if held is not None:
        out[held] = a / size[held]
        if not 0.0 < out[held] < 1.0:
            held = None
    return out, held


def land(size: np.ndarray, part: np.ndarray, held: int | None) -> np.ndarray:
    """Settle the last document left over to the nearer whole number, and make up for the words that this adds
    or takes away by turning over other documents of the group, largest first, while that brings the sum nearer.
    """
    out = part.copy()
    if held is None:
        return out
    out[held] = np.round(part[held])
    short = (part[held] - out[held]) * size[held]
    for j in np.argsort(-size, kind="stable"):
        step = size[j] if out[j] == 0.0 else -size[j]
        if j != held and abs(short - step) < abs(short):
            out[j] = 1.0 - out[j]
            short -= step
    return out


def _round_level(rows: DataFrame, buckets: DataFrame, level: int, seed: int) -> DataFrame:
    """One level of the tree: rows (ROUNDED without settled) in buckets of their source."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "tie", "nth", "doc_id"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        rng = np.random.default_rng([seed, level, int(key[0]), int(key[1])])
        part, held = settle(group["size"].to_numpy(np.float64), group["part"].to_numpy(np.float64), rng)
        if group["buckets"][0] == 1:
            part, held = land(group["size"].to_numpy(np.float64), part, held), None
        group["part"] = part
        group["settled"] = np.arange(len(group)) != (-1 if held is None else held)
        group["level"] = level
        return group[["doc_id", "sid", "size", "tie", "nth", "whole", "part", "level", "settled"]].astype({"doc_id": "Int64"})

    spread = rows.join(buckets, "sid").withColumn(
        "bucket", F.pmod(F.xxhash64("tie", "nth", F.lit(level)), F.greatest(F.col("buckets"), F.lit(1)))
    )
    return spread.groupBy("sid", "bucket").applyInPandas(run, ROUNDED)


def _told_apart(rows: DataFrame) -> DataFrame:
    """Rows with ``nth``, the number of a row among its equals, so that equal rows part as others do.

    Equal rows are counted and made again in runs, which are dealt out; so no task holds all of them.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("equal"))
    runs = counted.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("equal") - 1) / RUN))).alias("run"))
    runs = runs.repartition("tie", "run")
    last = F.least(F.col("equal"), (F.col("run") + 1) * RUN) - 1
    return runs.select(*rows.columns, F.explode(F.sequence(F.col("run") * RUN, last)).alias("nth"))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    most: int = 3,
    seed: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tie: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken, tie.

    A NULL text has no words; NULL sources form one source, the last. A document without words is taken the
    whole part of its share, which adds nothing. Ids may be NULL or repeat: rows are told apart by their text as
    well, and equal rows may each get their own number of copies. The draws depend on ``seed``, the ids and the
    texts only. An empty table gives an empty result. ``tie`` tells rows apart, by default a hash of id, source and text.
    """
    spark = docs.sparkSession
    if tie is None:
        tie = F.xxhash64(F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.col(text_col))
    told = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        tie.alias("tie"),
    )
    rows = materialise(_told_apart(told), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    targets = materialise(source_targets(sizes, weights, most), "targets")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    told = rows.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    start = told.select(
        "doc_id",
        "sid",
        "size",
        "tie",
        "nth",
        F.floor(share).cast("int").alias("whole"),
        (share - F.floor(share)).alias("part"),
    )
    done: list[DataFrame] = []
    left, buckets, level = start, targets.select("sid", F.ceil(F.col("documents") / BUCKET).alias("buckets")), 0
    while True:
        rounded = materialise(_round_level(left, buckets, level, seed), f"level{level}")
        done.append(rounded.where("settled"))
        left = rounded.where(~F.col("settled"))
        counts = materialise(left.groupBy("sid").agg(F.count(F.lit(1)).alias("n")), f"left{level}")
        if counts.isEmpty():
            break
        buckets = counts.select("sid", F.ceil(F.col("n") / BUCKET).alias("buckets"))
        left = left.drop("level", "settled")
        level += 1
    all_rows = done[0]
    for more in done[1:]:
        all_rows = all_rows.unionByName(more)
    copies = F.col("whole") + F.col("part").cast("int")
    named = targets.select("sid", "source", "source_size", "target")
    return all_rows.join(named, "sid").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"),
        "tie",
    )
