"""Codebooks: column profiles joined to human labels, and the analysis extract."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyst.operators.columns import drop_all_zero


WHOLE = ("tinyint", "smallint", "int", "bigint")
NUMBER = (*WHOLE, "float", "double")
#: Bits of one bitmap of Spark's bitmap functions, and the bitmaps a column may take in a shared aggregate.
BITMAP_BITS, BITMAPS = 8 * 4096, 8
#: Accuracy of distinct-count sketches, as the binary logarithm of their registers.
SKETCH_SIZE = 14


def distinct_sketches(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(variable, sketch)``: a HyperLogLog sketch of the values of each column, for :func:`merged_distinct`."""
    row = df.agg(*[_sketch(df, c).alias(f"s{i}") for i, c in enumerate(cols)])
    cells = [F.struct(F.lit(c).alias("variable"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(cols)]
    return row.select(F.inline(F.array(*cells)))


def merged_distinct(sketches: DataFrame) -> DataFrame:
    """``(variable, n_distinct)`` of sketches of several tables, such as the waves of a study, put together."""
    merged = F.hll_union_agg("sketch", F.lit(True))
    return sketches.groupBy("variable").agg(F.hll_sketch_estimate(merged).alias("n_distinct"))


def _sketch(df: DataFrame, c: str) -> Column:
    col = F.col(c)
    return F.hll_sketch_agg(col if df.schema[c].dataType.simpleString() in ("int", "bigint") else col.cast("string"), F.lit(SKETCH_SIZE))


def _whole_counts(df: DataFrame, ends: Mapping[str, tuple[int, int]]) -> dict[str, int]:
    """Distinct values of whole-number columns between known ends, all by bitmaps in one aggregate."""
    aggs = []
    for c, (low, high) in ends.items():
        at = F.col(c).cast("long") - low
        counts = []
        for k in range((high - low) // BITMAP_BITS + 1):
            inside = F.when(F.floor(at / BITMAP_BITS) == k, at - k * BITMAP_BITS)
            counts.append(F.bitmap_count(F.bitmap_construct_agg(inside)))
        aggs.append(sum(counts[1:], counts[0]).alias(c))
    return df.agg(*aggs).first().asDict() if aggs else {}


def _wide_count(df: DataFrame, c: str, low: int) -> int:
    """Distinct values of a whole-number column of a wide range that its values fill well: a bitmap for each part of it."""
    at = F.col(c).cast("long") - low
    parts = df.where(F.col(c).isNotNull()).groupBy(F.floor(at / BITMAP_BITS).alias("part"))
    bits = parts.agg(F.bitmap_count(F.bitmap_construct_agg(F.pmod(at, F.lit(BITMAP_BITS)))).alias("n"))
    return bits.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _exact_distinct(df: DataFrame, kinds: Mapping[str, str], row: Mapping) -> DataFrame:
    """``(variable, n_distinct)``; ``row`` holds the count and both ends of each column by its place.

    Whole numbers are counted by bitmaps: in one aggregate where the range is narrow, by parts of the range where it
    is wide and a bitmap takes no more room than the values. The other columns are turned into rows, and their distinct
    values shuffled.
    """
    narrow, counted, rest = {}, {}, []
    for i, (c, kind) in enumerate(kinds.items()):
        n = row[f"a{i}"]
        if kind not in WHOLE or not n:
            rest.append(c)
            continue
        low, high = int(row[f"l{i}"]), int(row[f"h{i}"])
        if high - low < BITMAPS * BITMAP_BITS:
            narrow[c] = (low, high)
        elif high - low < 64 * n:
            counted[c] = _wide_count(df, c, low)
        else:
            rest.append(c)
    counted |= _whole_counts(df, narrow)
    known = df.sparkSession.createDataFrame(list(counted.items()), "variable string, n_distinct long")
    if not rest:
        return known
    values = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in rest])
    found = df.select(F.inline(values)).where(F.col("value").isNotNull()).distinct()
    return known.unionByName(found.groupBy("variable").agg(F.count(F.lit(1)).alias("n_distinct")))


def profile(df: DataFrame, cols: Sequence[str] | None = None, exact_distinct: bool = False) -> DataFrame:
    """One row per column: type, rows, NULLs, min, max, distinct count, 0/1 flag.

    One aggregate over the table. Distinct counts are estimates of HyperLogLog sketches unless ``exact_distinct``,
    which runs that aggregate at once and a second one of bitmaps, see :func:`_exact_distinct`.
    """
    cols = list(cols or df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("_rows")]
    cells = []
    for i, c in enumerate(cols):
        col = F.col(c)
        number = types[c] in NUMBER
        binary = F.count_if(col.isin(0, 1)) if number else F.lit(0)
        aggs += [
            F.count(col).alias(f"a{i}"),
            F.min(col).cast("string").alias(f"l{i}"),
            F.max(col).cast("string").alias(f"h{i}"),
            *([] if exact_distinct else [F.hll_sketch_estimate(_sketch(df, c)).alias(f"d{i}")]),
            *([binary.alias(f"b{i}")] if number else []),
        ]
        is_binary = (
            ((F.col(f"b{i}") == F.col(f"a{i}")) & (F.col(f"a{i}") > 0)).cast("int") if number else F.lit(0)
        )
        cells.append(
            F.struct(
                F.lit(c).alias("variable"),
                F.lit(types[c]).alias("type"),
                F.col("_rows").alias("n_rows"),
                (F.col("_rows") - F.col(f"a{i}")).alias("n_null"),
                F.col(f"l{i}").alias("min"),
                F.col(f"h{i}").alias("max"),
                *([] if exact_distinct else [F.coalesce(f"d{i}", F.lit(0)).alias("n_distinct")]),
                is_binary.alias("is_binary"),
            )
        )
    row = df.agg(*aggs)
    if not exact_distinct:
        return row.select(F.inline(F.array(*cells)))
    found = row.first()
    shown = df.sparkSession.createDataFrame([found], row.schema).select(F.inline(F.array(*cells)))
    counts = _exact_distinct(df, {c: types[c] for c in cols}, found)
    names = ["variable", "type", "n_rows", "n_null", "min", "max", "n_distinct", "is_binary"]
    return shown.join(counts, "variable", "left").fillna(0, "n_distinct").select(*names)


def codebook(df: DataFrame, labels: DataFrame, cols: Sequence[str] | None = None, **kw) -> DataFrame:
    """Profile of the surviving columns with their labels (``variable, label``)."""
    return labels.join(profile(df, cols, **kw), "variable", "right")


def with_labels(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Store labels in the column metadata, where they travel with the schema."""
    out = df
    for c, text in labels.items():
        if c in df.columns:
            out = out.withMetadata(c, {"label": text})
    return out


def metadata_labels(df: DataFrame) -> DataFrame:
    """``(variable, description)`` from column metadata; a driver-side schema read."""
    rows = [(f.name, f.metadata.get("label")) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "variable string, description string")


def analysis_extract(
    df: DataFrame,
    cols: Sequence[str],
    retained: Column,
    adult: Column,
    complete: Sequence[str],
) -> DataFrame:
    """Retained rows and chosen columns; all-zero columns go first, then the age
    rule and the listwise rule apply."""
    kept = drop_all_zero(df.where(retained).select(*cols))
    return kept.where(adult).dropna(subset=list(complete))
