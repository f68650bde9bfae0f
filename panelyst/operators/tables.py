"""Summary tables by group with an overall column, kept long and numeric.

Every table has one row per (block, level or variable, group). ``grp`` is the
group's label and NULL on the overall row, which ``is_overall`` = 1 marks. Cells
with no rows are present with 0. Text such as ``12/40 (30.0%)`` is made last,
by :func:`formatted`, and :func:`wide` spreads the groups into columns.

The data are read once per table kind and collapse, map side, to
(group, level) counts or per-group moments; everything after that works on
rows whose number depends on levels and groups only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelyst.functions.nulls import all_in, is_in
from panelyst.functions.scalars import count_text, ratio
from panelyst.operators.clean import SPECIAL_LEVELS
from panelyst.operators.quantiles import quantiles_of_many
from panelyst.sources.sinks import materialise

OTHER = "Other"
#: Buckets that the levels of a free text are put in to bound their counts.
BUCKETS = 1 << 16
#: Levels of a header that meet its groups in one part of the grid.
LEVELS_IN_PART = 256


def level_counts(
    df: DataFrame,
    group: str,
    factors: Mapping[str, str] | Sequence[str],
    exclude: Sequence[str] = SPECIAL_LEVELS,
) -> DataFrame:
    """``(header, grp, level, n)`` for many factors in one pass over the data.

    ``factors`` may map column to header. The factors of a row are turned into rows inside the scan stage and
    collapse there again, so only (factor, group, level) counts are shuffled.
    """
    headers = dict(factors) if isinstance(factors, Mapping) else {f: f for f in factors}
    cells = F.array(
        *[
            F.struct(F.lit(h).alias("header"), F.col(f).cast("string").alias("level"))
            for f, h in headers.items()
        ]
    )
    return (
        df.select(F.col(group).cast("string").alias("grp"), F.inline(cells))
        .where(F.col("level").isNotNull() & ~F.col("level").isin(list(exclude)))
        .groupBy("header", "grp", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_levels(counts: DataFrame, n: int, level: str = "level", weight: str = "n", skip: Sequence[str] = ()) -> DataFrame:
    """``(rank, level, n)`` of the n most frequent levels but for ``skip``, ties by name.

    A distributed top-k; only its n rows meet in one place.
    """
    # ``skip`` is told by an aggregate, so that the filter stays above the counts and their scan can be shared
    best = counts.groupBy(level).agg(F.sum(weight).alias("_w"), F.max(is_in(level, skip)).alias("_skip"))
    best = best.where(~F.col("_skip")).orderBy(F.desc("_w"), F.asc(level)).limit(n)
    packed = best.agg(
        F.sort_array(F.collect_list(F.struct((-F.col("_w")).alias("k"), F.col(level).alias("v")))).alias("a")
    )
    return packed.select(F.posexplode("a").alias("pos", "x")).select(
        (F.col("pos") + 1).alias("rank"), F.col("x.v").alias(level), (-F.col("x.k")).alias("n")
    )


def lump_map(counts: DataFrame, n: int, keep: Sequence[str] = (), other: str = OTHER) -> Column:
    """Level expression that turns all but the top n and ``keep`` into ``other``.

    Nothing is lumped unless more than n + 1 levels (``keep`` aside) remain, so
    the n + 2 most frequent ones are all that has to be known.
    """
    top = top_levels(counts, n + 2, skip=keep)
    names = top.agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "level"))), lambda x: x["level"]
        ).alias("a")
    ).scalar()
    pos = F.array_position(names, F.col("level"))
    kept = is_in("level", keep) | (F.size(names) < n + 2) | pos.between(1, n)
    return F.when(kept, F.col("level")).otherwise(other)


def heavy_levels(rows: DataFrame, n: int, level: str = "level") -> list[tuple[str, int]]:
    """The n most frequent levels with their counts, ties by name, without a shuffle of all levels.

    The rows are counted by a hash bucket of their level, which no level in it can exceed. The levels in the fullest
    buckets are counted exactly; the n-th best of them bounds from below what a level must have. Where other
    buckets reach that bound, their levels are counted exactly too. So the result is exact, and of many levels
    only those are shuffled that share a bucket with a frequent one.
    """
    bucket = F.pmod(F.xxhash64(level), F.lit(BUCKETS)).cast("int")
    sums = materialise(rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")), "buckets")
    order = (F.desc("n"), F.asc(level))
    fullest = [r["bucket"] for r in sums.orderBy(F.desc("n"), "bucket").limit(4 * n).collect()]
    found = rows.where(bucket.isin(fullest)).groupBy(level).agg(F.count(F.lit(1)).alias("n"))
    found = materialise(found, "levels")
    best = found.orderBy(*order).limit(n).collect()
    bound = best[-1]["n"] if len(best) == n else 0
    reaching = sums.where((F.col("n") >= bound) & ~F.col("bucket").isin(fullest)).select("bucket")
    if not reaching.isEmpty():
        others = rows.withColumn("bucket", bucket).join(reaching, "bucket", "left_semi")
        counted = others.groupBy(level).agg(F.count(F.lit(1)).alias("n"))
        best = found.unionByName(counted).orderBy(*order).limit(n).collect()
    return [(r[level], r["n"]) for r in best]


def lumped_text(
    df: DataFrame, factor: str, n: int, keep: Sequence[str] = (), exclude: Sequence[str] = SPECIAL_LEVELS, other: str = OTHER
) -> Column:
    """A factor with all but its top n levels and ``keep`` turned into ``other``, for factors of very many levels.

    As :func:`lump_map`, nothing is lumped unless more than n + 1 levels, ``keep`` aside, remain; special levels stay.
    """
    text = F.col(factor).cast("string")
    aside = [*keep, *exclude]
    rows = df.select(text.alias("level")).where(F.col("level").isNotNull() & ~F.col("level").isin(aside))
    best = heavy_levels(rows, n + 2)
    if len(best) < n + 2:
        return text
    return F.when(text.isNull() | text.isin([*aside, *[name for name, _ in best[:n]]]), text).otherwise(other)


def _grid(levels: DataFrame, columns: DataFrame) -> DataFrame:
    """Each level beside each group of its header.

    A header's levels are dealt out in parts of about ``LEVELS_IN_PART``, and its groups go to each of them, so that
    a header with many of both is not the work of one task.
    """
    # the counts are asked for so that all branches need the same columns and share one exchange
    size = levels.groupBy("header").agg(F.ceil(F.count("level_n") / LEVELS_IN_PART).alias("parts"))
    part = F.pmod(F.xxhash64("level"), F.col("parts")).alias("part")
    tasks = int(levels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = levels.join(size, "header").select(*levels.columns, part).repartition(tasks, "header", "part")
    everywhere = columns.join(size, "header").select(*columns.columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return dealt.join(everywhere, ["header", "part"]).drop("part")


def _fill_cells(counts: DataFrame, headers: Sequence[str], groups: Sequence[str] | None) -> DataFrame:
    """Zero-filled (header, level, grp) cells with group totals and shares, as rows throughout.

    All parts come from the same counts, so Spark shares their exchange and reads the data once. The group is
    keyed as a struct: no filter for missing groups can then slip below the counts and part the scans.
    """
    counts = counts.withColumn("g", F.struct("grp")).drop("grp")
    per_group = counts.groupBy("header", "g").agg(F.sum("n").alias("total"))
    levels = counts.groupBy("header", "level").agg(F.sum("n").alias("level_n"))
    everyone = levels.join(
        counts.groupBy("header").agg(F.sum("n").alias("total")), "header"
    ).select("header", "level", "level_n", F.col("level_n").alias("n"), "total", F.lit(1).alias("is_overall"))
    if groups is None:
        named = F.max(F.col("g.grp").isNotNull())
        seen = per_group.groupBy("g").agg(F.sum("total").alias("_any"), named.alias("_named"))
        seen = seen.where("_any > 0 and _named").select("g")
    else:
        seen = counts.sparkSession.createDataFrame([(g,) for g in groups], "grp string").select(F.struct("grp").alias("g"))
    wanted = seen.withColumn("header", F.explode(F.array(*[F.lit(h) for h in headers])))
    columns = wanted.join(per_group, ["header", "g"], "left")
    cells = (
        _grid(levels, columns)
        .join(counts, ["header", "level", "g"], "left")
        .select("header", "level", "level_n", "g", "n", "total", F.lit(0).alias("is_overall"))
    )
    none = F.lit(None).cast("struct<grp:string>").alias("g")
    return (
        everyone.select("header", "level", "level_n", none, "n", "total", "is_overall")
        .unionByName(cells)
        .select(
            "header",
            "level",
            "level_n",
            F.col("g.grp").alias("grp"),
            "is_overall",
            F.coalesce("n", F.lit(0)).cast("long").alias("n"),
            F.coalesce("total", F.lit(0)).cast("long").alias("total"),
        )
        .withColumn("share", ratio("n", "total"))
    )


def one_factor_tables(
    df: DataFrame,
    group: str,
    factors: Mapping[str, str] | Sequence[str],
    groups: Sequence[str] | None = None,
    exclude: Sequence[str] = SPECIAL_LEVELS,
) -> DataFrame:
    """Frequency blocks of many factors from a single scan.

    ``factors`` may map column to header. Counts and shares are per group and
    overall; missing answers and special levels are in no denominator.
    """
    headers = list(factors.values()) if isinstance(factors, Mapping) else list(factors)
    return _fill_cells(level_counts(df, group, factors, exclude), list(dict.fromkeys(headers)), groups)


def one_factor_table(
    df: DataFrame,
    group: str,
    factor: str,
    header: str | None = None,
    n: int | None = None,
    keep: Sequence[str] = (),
    groups: Sequence[str] | None = None,
    exclude: Sequence[str] = SPECIAL_LEVELS,
    free_text: bool = False,
) -> DataFrame:
    """Frequency block of one factor, optionally lumped to its top n levels.

    ``keep`` protects levels from lumping and has no effect without ``n``. ``free_text`` says that the factor has
    very many levels: it is then lumped before it is counted, at the price of two more scans, see
    :func:`heavy_levels`. The result is the same.
    """
    if n is not None and free_text:
        df, n = df.withColumn("_lumped", lumped_text(df, factor, n, keep, exclude)), None
        header, factor = header or factor, "_lumped"
    counts = level_counts(df, group, {factor: header or factor}, exclude)
    if n is not None:
        counts = (
            counts.withColumn("level", lump_map(counts, n, keep))
            .groupBy("header", "grp", "level")
            .agg(F.sum("n").alias("n"))
        )
    return _fill_cells(counts, [header or factor], groups)


def level_ranks(
    table: DataFrame, relevel: Sequence[str] = (), keep: Sequence[str] = (), lumped: bool = False
) -> DataFrame:
    """Add ``level_rank``, the place of a level in its header: named levels first, then by frequency, kept ones.

    ``lumped`` says that the table was lumped: only then is ``Other`` a made-up level that stands last; else it
    is one like any other. Levels are ranked on one row each, not on the cells of all groups.
    """
    first = F.array_position(F.array(*[F.lit(x) for x in relevel]), F.col("level")) if relevel else F.lit(0)
    last = F.when(is_in("level", keep), 1).otherwise(0)
    if lumped:
        last = F.when(F.col("level") == OTHER, 2).otherwise(last)
    order = (F.when(first == 0, len(relevel) + 1).otherwise(first), last, F.desc("level_n"), F.asc("level"))
    ranked = table.where("is_overall = 1").select(
        "header", "level", F.row_number().over(W.partitionBy("header").orderBy(*order)).alias("level_rank")
    )
    return table.join(ranked, ["header", "level"])


def ordered_levels(
    table: DataFrame, relevel: Sequence[str] = (), keep: Sequence[str] = (), lumped: bool = False
) -> DataFrame:
    """The rows of a table in display order, see :func:`level_ranks`; overall first, then groups by name."""
    ranked = level_ranks(table, relevel, keep, lumped)
    return ranked.orderBy("header", "level_rank", F.desc("is_overall"), "grp")


def many_binary_table(
    df: DataFrame,
    group: str,
    variables: Mapping[str, str],
    header: str,
    n: int | None = None,
    keep: Sequence[str] = (),
    groups: Sequence[str] | None = None,
) -> DataFrame:
    """Check-all-that-apply block: how many ticked each box, per group and overall.

    Rows with any box not 0/1 are left out of the block. With ``n``, boxes
    beyond the n most ticked (``keep`` aside) are OR-ed into one ``Other`` box, if
    more than n + 1 are there.
    """
    items = list(variables)
    rows = df.select(F.col(group).cast("string").alias("grp"), *items).where(all_in(items))
    taken = None
    boxes: dict[str, Column] = {i: F.col(i).cast("long") for i in items}
    loose = [i for i in items if i not in keep]
    if n is not None and len(loose) > n + 1:
        sums = rows.agg(*[F.sum(i).alias(i) for i in loose])
        ranked = F.sort_array(
            F.array(
                *[F.struct((-F.col(f"`{i}`")).alias("k"), F.lit(loose.index(i)).alias("p")) for i in loose]
            )
        )
        # Positions of the boxes that stay; ties keep the order given.
        taken = sums.select(
            F.transform(F.filter(ranked, lambda _, at: at < n), lambda x: x["p"])
        ).scalar()
        rows = rows.withColumn("_kept", taken)
        boxes[OTHER] = F.greatest(
            *[
                F.when(F.array_contains("_kept", loose.index(i)), 0).otherwise(F.col(i)).cast("long")
                for i in loose
            ]
        )
    sums = rows.groupBy("grp").agg(
        F.count(F.lit(1)).alias("_rows"),
        *([F.first("_kept").alias("_kept")] if taken is not None else []),
        *[F.sum(expr).alias(name) for name, expr in boxes.items()],
    )
    cells = []
    for name in boxes:
        shown = F.lit(True)
        if taken is not None and name in loose:
            shown = F.array_contains("_kept", loose.index(name))
        cells.append(
            F.struct(
                F.lit(name).alias("variable"),
                F.lit(variables.get(name, OTHER)).alias("level"),
                F.col(f"`{name}`").alias("n"),
                shown.alias("shown"),
            )
        )
    long = sums.select("grp", "_rows", F.inline(F.array(*cells))).where("shown")
    everyone = long.groupBy("variable", "level").agg(F.sum("n").alias("level_n"), F.sum("_rows").alias("all_rows"))
    if groups is None:
        cells = long.where(F.col("grp").isNotNull()).join(everyone, ["variable", "level"])
    else:
        listed = everyone.withColumn("grp", F.explode(F.array(*[F.lit(g) for g in groups])))
        cells = listed.join(long, ["variable", "level", "grp"], "left")
    overall = everyone.select(
        "variable", "level", "level_n", F.lit(None).cast("string").alias("grp"), F.lit(1).alias("is_overall"),
        F.col("level_n").alias("n"), F.col("all_rows").alias("_rows"),
    )
    of_groups = cells.select("variable", "level", "level_n", "grp", F.lit(0).alias("is_overall"), "n", "_rows")
    return (
        overall.unionByName(of_groups)
        .select(
            F.lit(header).alias("header"),
            "variable",
            "level",
            "level_n",
            "grp",
            "is_overall",
            F.coalesce("n", F.lit(0)).cast("long").alias("n"),
            F.coalesce("_rows", F.lit(0)).cast("long").alias("total"),
        )
        .withColumn("share", ratio("n", "total"))
    )


def group_moments(df: DataFrame, group: str, variables: Sequence[str]) -> DataFrame:
    """``(variable, grp, n, mean, m2, min, max)`` of many variables in one pass."""
    aggs, cells = [], []
    for i, v in enumerate(variables):
        c = F.col(v).cast("double")
        aggs += [
            F.count(c).alias(f"n{i}"),
            F.avg(c).alias(f"a{i}"),
            F.var_pop(c).alias(f"v{i}"),
            F.min(c).alias(f"l{i}"),
            F.max(c).alias(f"h{i}"),
        ]
        cells.append(
            F.struct(
                F.lit(v).alias("variable"),
                F.col(f"n{i}").alias("n"),
                F.col(f"a{i}").alias("mean"),
                (F.col(f"v{i}") * F.col(f"n{i}")).alias("m2"),
                F.col(f"l{i}").alias("min"),
                F.col(f"h{i}").alias("max"),
            )
        )
    sums = df.groupBy(F.col(group).cast("string").alias("grp")).agg(*aggs)
    return sums.select("grp", F.inline(F.array(*cells)))


def merged_moments(moments: DataFrame) -> DataFrame:
    """Moments of all groups together, from the moments of each."""
    total, mean = F.sum("n"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n"))
    overall = moments.groupBy("variable").agg(
        total.alias("n"),
        mean.alias("mean"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )
    spread = (
        moments.join(overall.select("variable", F.col("mean").alias("_m")), "variable")
        .groupBy("variable")
        .agg(F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_m"), 2)).alias("m2"))
    )
    return overall.join(spread, "variable").select("variable", "n", "mean", "m2", "min", "max")


def continuous_tables(
    df: DataFrame,
    group: str,
    variables: Mapping[str, str] | Sequence[str],
    stat: str = "mean",
) -> DataFrame:
    """Mean and SD, or median and quartiles, per group and overall.

    ``range_min`` and ``range_max`` are over everyone, on every row. The variables
    share one scan.
    """
    if stat not in ("mean", "median"):
        raise ValueError(f"no such summary: {stat!r}; 'mean' and 'median' are known")
    labels = dict(variables) if isinstance(variables, Mapping) else {v: v for v in variables}
    if stat == "mean":
        by_group = group_moments(df, group, list(labels)).withColumn("is_overall", F.lit(0))
        overall = merged_moments(by_group).withColumns(
            {"grp": F.lit(None).cast("string"), "is_overall": F.lit(1)}
        )
        table = (
            by_group.where(F.col("grp").isNotNull())
            .unionByName(overall)
            .withColumn("sd", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))))
        )
        ends = overall.select(
            "variable", F.col("min").alias("range_min"), F.col("max").alias("range_max")
        )
        table = table.join(ends, "variable").select(
            "variable", "grp", "is_overall", "n", "mean", "sd", "range_min", "range_max"
        )
    else:
        named = df.select(F.col(group).cast("string").alias("grp"), *labels)
        found = quantiles_of_many(named, list(labels), [0.0, 0.25, 0.5, 0.75, 1.0], ["grp"], overall=True)
        # Over the finished rows, one per variable and group.
        rows = W.partitionBy("variable")
        everyone = F.col("is_overall") == 1
        table = found.where(everyone | F.col("grp").isNotNull()).select(
            "variable",
            "grp",
            "is_overall",
            "n",
            F.col("q3").alias("median"),
            F.col("q2").alias("q25"),
            F.col("q4").alias("q75"),
            F.max(F.when(everyone, F.col("q1"))).over(rows).alias("range_min"),
            F.max(F.when(everyone, F.col("q5"))).over(rows).alias("range_max"),
        )
    label = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return table.withColumn("header", F.element_at(label, F.col("variable")))


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """Rows per group and overall, with a header text such as ``A (N=12)``."""
    per_group = df.groupBy(F.col(group).cast("string").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    everyone = per_group.agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("grp"), "n")
    both = per_group.where(F.col("grp").isNotNull()).withColumn("is_overall", F.lit(0)).unionByName(
        everyone.withColumn("is_overall", F.lit(1))
    )
    return both.withColumn(
        "heading",
        F.format_string("%s (N=%d)", F.coalesce("grp", F.lit("Overall")), F.col("n")),
    )


def formatted(table: DataFrame, digits: int = 1) -> DataFrame:
    """Add ``cell``: ``n/N (p%)`` overall and ``n (p%)`` per group, or mean/median text."""
    if "share" in table.columns:
        cell = F.when(F.col("is_overall") == 1, count_text("n", "share", "total")).otherwise(
            count_text("n", "share")
        )
    elif "mean" in table.columns:
        cell = F.format_string(f"%.{digits}f (%.{digits}f)", "mean", "sd")
    else:
        cell = F.format_string(f"%.{digits}f [%.{digits}f-%.{digits}f]", "median", "q25", "q75")
    return table.withColumn("cell", cell)


def wide(table: DataFrame, rows: Sequence[str], groups: Sequence[str], value: str = "cell") -> DataFrame:
    """One column per group plus ``Overall``, over an explicit group list."""
    return (
        table.withColumn("grp", F.when(F.col("is_overall") == 1, F.lit("Overall")).otherwise(F.col("grp")))
        .groupBy(*rows)
        .pivot("grp", ["Overall", *groups])
        .agg(F.first(value))
    )


def report(blocks: Mapping[str, Sequence[DataFrame]]) -> DataFrame:
    """Stack table blocks into one long table keyed by (table, block, header, ...)."""
    parts = []
    for table, frames in blocks.items():
        for i, frame in enumerate(frames, 1):
            parts.append(frame.withColumns({"table": F.lit(table), "block": F.lit(i)}))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
