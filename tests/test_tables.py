from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelyst.operators import tables as T

PEOPLE = [
    ("A", "x"),
    ("A", "x"),
    ("A", "y"),
    ("B", "x"),
    ("B", None),
    ("B", "Skipped"),
    (None, "z"),
]


@pytest.fixture
def people(spark):
    return spark.createDataFrame(PEOPLE, "site string, ans string")


def cells(table, *cols):
    return {tuple(r[c] for c in ("level", "grp")): tuple(r[c] for c in cols) for r in table.collect()}


def test_one_factor_counts_zero_cells_and_totals(people):
    got = cells(T.one_factor_table(people, "site", "ans"), "n", "total", "share")
    assert got == {
        ("x", None): (3, 5, 0.6),
        ("y", None): (1, 5, 0.2),
        ("z", None): (1, 5, 0.2),
        ("x", "A"): (2, 3, 2 / 3),
        ("y", "A"): (1, 3, 1 / 3),
        ("z", "A"): (0, 3, 0.0),
        ("x", "B"): (1, 1, 1.0),
        ("y", "B"): (0, 1, 0.0),
        ("z", "B"): (0, 1, 0.0),
    }


def test_explicit_groups_add_empty_ones(people):
    got = cells(T.one_factor_table(people, "site", "ans", groups=["A", "C"]), "n", "total", "share")
    assert got[("x", "C")] == (0, 0, None) and ("x", "B") not in got


def test_groups_sum_to_overall_without_missing_groups(people):
    rows = T.one_factor_table(people.where("site IS NOT NULL"), "site", "ans").collect()
    for level in {r["level"] for r in rows}:
        parts = sum(r["n"] for r in rows if r["level"] == level and not r["is_overall"])
        whole = [r["n"] for r in rows if r["level"] == level and r["is_overall"]]
        assert [parts] == whole


def test_many_factors_equal_single_ones(spark):
    df = spark.range(300).select(
        (F.col("id") % 3).cast("string").alias("g"),
        (F.col("id") % 5).cast("string").alias("a"),
        (F.col("id") * 7 % 4).cast("string").alias("b"),
    )
    both = T.one_factor_tables(df, "g", {"a": "First", "b": "Second"})
    for factor, header in (("a", "First"), ("b", "Second")):
        alone = T.one_factor_table(df, "g", factor, header=header)
        assert both.where(F.col("header") == header).exceptAll(alone.select(both.columns)).count() == 0


LEVELS = [("a", 9), ("b", 7), ("c", 5), ("d", 3), ("e", 1)]


@pytest.mark.parametrize(
    "n, keep, expected",
    [
        (2, [], {"a": 9, "b": 7, "Other": 9}),
        (4, [], dict(LEVELS)),  # n + 1 levels: nothing to lump
        (3, [], {"a": 9, "b": 7, "c": 5, "Other": 4}),
        (1, ["e"], {"a": 9, "e": 1, "Other": 15}),
        (3, ["e"], dict(LEVELS)),
        (0, [], {"Other": 25}),
    ],
)
def test_lumping(spark, n, keep, expected):
    df = spark.createDataFrame([("g", lev) for lev, k in LEVELS for _ in range(k)], "g string, f string")
    table = T.one_factor_table(df, "g", "f", n=n, keep=keep)
    assert {r["level"]: r["n"] for r in table.where("is_overall = 1").collect()} == expected


def test_lump_ties_go_by_name(spark):
    df = spark.createDataFrame([("g", lev) for lev in "ddccbbaa"], "g string, f string")
    assert {r["level"] for r in T.one_factor_table(df, "g", "f", n=2).collect()} == {"a", "b", "Other"}


def test_level_order(spark):
    df = spark.createDataFrame([("g", lev) for lev, k in LEVELS for _ in range(k)], "g string, f string")
    table = T.one_factor_table(df, "g", "f", n=2, keep=["e"])
    order = [r["level"] for r in T.ordered_levels(table, ["b"], ["e"], lumped=True).where("is_overall = 1").collect()]
    assert order == ["b", "a", "e", "Other"]


BOXES = [("A", 1, 0, 1), ("A", 1, 1, 0), ("B", 0, 0, 1), ("B", 1, 9, 1), ("B", None, 0, 0), ("A", 1, 0, 0)]


def test_many_binary_leaves_out_incomplete_rows(spark):
    df = spark.createDataFrame(BOXES, "s string, p int, q int, r int")
    got = cells(T.many_binary_table(df, "s", {"p": "P", "q": "Q", "r": "R"}, "H"), "n", "total")
    assert got == {
        ("P", None): (3, 4),
        ("Q", None): (1, 4),
        ("R", None): (2, 4),
        ("P", "A"): (3, 3),
        ("Q", "A"): (1, 3),
        ("R", "A"): (1, 3),
        ("P", "B"): (0, 1),
        ("Q", "B"): (0, 1),
        ("R", "B"): (1, 1),
    }


def test_many_binary_other_counts_people_once(spark):
    df = spark.createDataFrame([("A", 1, 1, 1, 0), ("A", 1, 0, 0, 1), ("A", 1, 0, 0, 0)], "s string, p int, q int, r int, t int")
    labels = {"p": "P", "q": "Q", "r": "R", "t": "T"}
    got = cells(T.many_binary_table(df, "s", labels, "H", n=1), "n")
    # q, r and t fall into Other: two people have at least one of them.
    assert got == {("P", None): (3,), ("P", "A"): (3,), ("Other", None): (2,), ("Other", "A"): (2,)}
    kept = cells(T.many_binary_table(df, "s", labels, "H", n=1, keep=["t"]), "n")
    assert kept[("T", None)] == (1,) and kept[("Other", None)] == (1,)


def test_continuous_mean(spark):
    df = spark.createDataFrame([("A", 1.0), ("A", 3.0), ("B", 8.0), ("B", None), (None, 4.0)], "s string, v double")
    got = {r["grp"]: (r["n"], r["mean"], r["sd"], r["range_min"], r["range_max"]) for r in T.continuous_tables(df, "s", ["v"]).collect()}
    assert got["A"] == (2, 2.0, pytest.approx(2**0.5), 1.0, 8.0)
    assert got["B"] == (1, 8.0, None, 1.0, 8.0)
    n, mean, sd, low, high = got[None]
    values = [1.0, 3.0, 8.0, 4.0]
    centre = sum(values) / 4
    assert (n, mean, low, high) == (4, centre, 1.0, 8.0)
    assert sd == pytest.approx((sum((v - centre) ** 2 for v in values) / 3) ** 0.5)


def test_continuous_median(spark):
    df = spark.createDataFrame([("A", v) for v in (1, 2, 3, 10)] + [("B", 5)], "s string, v int")
    got = {r["grp"]: (r["median"], r["q25"], r["q75"], r["range_max"]) for r in T.continuous_tables(df, "s", ["v"], "median").collect()}
    assert got["A"] == (2.5, 1.75, 4.75, 10.0)
    assert got["B"] == (5.0, 5.0, 5.0, 10.0)
    assert got[None] == (3.0, 2.0, 5.0, 10.0)


def test_unknown_statistic_is_refused(spark):
    with pytest.raises(ValueError, match="mean"):
        T.continuous_tables(spark.range(1), "id", ["id"], "mode")


def test_every_cell_of_many_groups(spark):
    df = spark.range(20_001).select(F.col("id").cast("string").alias("g"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("f"))
    table = T.one_factor_table(df, "g", "f")
    sums = table.where("is_overall = 0").groupBy("level").agg(F.count("*").alias("cells"), F.sum("n").alias("n")).collect()
    assert sorted(map(tuple, sums)) == [("x", 20_001, 10_001), ("y", 20_001, 10_000)]
    boxes = T.many_binary_table(df.select("g", F.lit(1).alias("p"), F.lit(0).alias("q")), "g", {"p": "P", "q": "Q"}, "H")
    assert boxes.count() == 2 * 20_002


def scans(df):
    """How often the executed plan reads files."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan")


@pytest.mark.parametrize("lump", [None, 2])
def test_a_block_reads_the_data_once(spark, tmp_path, lump):
    rows = [("g%d" % (k % 7), lev) for k, (lev, m) in enumerate(LEVELS) for _ in range(m)] + [(None, "a"), ("g1", None)]
    spark.createDataFrame(rows, "g string, f string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert scans(T.one_factor_table(df, "g", "f", n=lump, keep=["e"])) == 1


def test_other_is_last_only_if_it_was_made(spark):
    rows = [("g", "Other")] * 5 + [("g", "a")] * 3 + [("g", "b")]
    table = T.one_factor_table(spark.createDataFrame(rows, "g string, f string"), "g", "f")

    def order(lumped):
        return [r["level"] for r in T.ordered_levels(table, lumped=lumped).where("is_overall = 1").collect()]

    assert order(False) == ["Other", "a", "b"] and order(True) == ["a", "b", "Other"]


def test_formatting_and_wide(people):
    table = T.one_factor_table(people, "site", "ans", groups=["A", "B"])
    got = {r["level"]: (r["Overall"], r["A"], r["B"]) for r in T.wide(T.formatted(table), ["level"], ["A", "B"]).collect()}
    assert got["x"] == ("3/5 (60.0%)", "2 (66.7%)", "1 (100.0%)")
    assert got["z"] == ("1/5 (20.0%)", "0 (0.0%)", "0 (0.0%)")


def test_group_sizes(people):
    got = {r["heading"] for r in T.group_sizes(people, "site").collect()}
    assert got == {"Overall (N=7)", "A (N=3)", "B (N=3)"}


def counted_levels(spark, kind):
    if kind == "tail":  # a few frequent levels before very many rare ones
        level = "CASE WHEN id % 3 = 0 THEN concat('often', CAST(id % 12 AS STRING)) ELSE concat('t', CAST(id AS STRING)) END"
    else:  # all alike: names decide
        level = "concat('t', CAST(id % 2000 AS STRING))"
    return spark.range(20_000).selectExpr(f"{level} AS level", "CAST(id % 3 AS STRING) AS g")


@pytest.mark.parametrize("kind", ["tail", "flat"])
@pytest.mark.parametrize("buckets", [4, 1 << 16])
def test_frequent_levels_are_exact(spark, monkeypatch, kind, buckets):
    monkeypatch.setattr(T, "BUCKETS", buckets)
    rows = counted_levels(spark, kind)
    want = [(r["level"], r["n"]) for r in rows.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "level").limit(7).collect()]
    assert T.heavy_levels(rows, 7) == want
    assert T.heavy_levels(rows.where("false"), 7) == []
    assert len(T.heavy_levels(rows.where("level IN ('t1', 't2')"), 7)) <= 2


@pytest.mark.parametrize("n", [3, 6000])
def test_lumping_a_free_text_first_changes_nothing(spark, rows, n):
    df = counted_levels(spark, "tail").where("level LIKE 'often%' OR length(level) < 4").union(spark.createDataFrame([("Missing", "1"), (None, "1"), ("Other", "2")], "level string, g string"))
    plain = T.one_factor_table(df, "g", "level", "L", n=n, keep=["t1"])
    early = T.one_factor_table(df, "g", "level", "L", n=n, keep=["t1"], free_text=True)
    assert rows(early, *plain.columns) == rows(plain)


def test_a_grid_of_one_header_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(T, "LEVELS_IN_PART", 8)
    monkeypatch.setattr(spark.conf, "get", lambda name, *a, get=spark.conf.get: "16" if name == "spark.sql.shuffle.partitions" else get(name, *a))
    levels = spark.range(400).selectExpr("'h' AS header", "CAST(id AS STRING) AS level", "id AS level_n")
    groups = spark.range(300).selectExpr("'h' AS header", "struct(CAST(id AS STRING) AS grp) AS g", "id AS total")
    grid = T._grid(levels, groups)
    by_task = [r["count"] for r in grid.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(by_task) == 400 * 300 and len(by_task) >= 8 and max(by_task) < 0.3 * sum(by_task)
    assert grid.distinct().count() == 400 * 300

