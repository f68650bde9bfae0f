from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelyst.operators import quantiles as Q

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def frames(spark):
    """Few values, many values, ties, heavy tails, a hot value, one row, negatives."""
    n = 5000
    rng = np.random.default_rng(7)
    parts = {
        "codes": rng.integers(0, 5, n),
        "uniform": rng.random(n),
        "tail": np.exp(rng.normal(0, 4, n)),
        "hot": np.where(rng.random(n) < 0.7, 3.0, rng.random(n) * 100),
        "single": np.array([4.5]),
        "pair": np.array([-1.0, 2.0]),
        "negative": -np.abs(rng.normal(0, 1, 777)),
    }
    rows = [(k, float(v)) for k, vs in parts.items() for v in vs]
    return spark.createDataFrame(rows + [("codes", None)], "g string, v double"), parts


def test_exact_quantiles_match_numpy(spark):
    df, parts = frames(spark)
    got = {(r["g"], r["is_overall"]): r for r in Q.exact_quantiles(df, "v", PROBS, ["g"], overall=True).collect()}
    assert len(got) == len(parts) + 1
    everyone = np.concatenate(list(parts.values()))
    for key, values in [((k, 0), v) for k, v in parts.items()] + [((None, 1), everyone)]:
        row = got[key]
        assert row["n"] == len(values)
        for i, p in enumerate(PROBS, 1):
            assert row[f"q{i}"] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12), (key, p)


def test_running_total_is_exact(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).cast("double").alias("v"), (F.col("id") % 4 + 1).alias("w"))
    got = sorted((r["v"], r["cum"], r["total"]) for r in Q.running_total(df, "v", "w").collect())
    rows = sorted((r["v"], r["w"]) for r in df.collect())
    total, cum, want = sum(w for _, w in rows), 0, []
    for v, w in rows:
        cum += w
        want.append((v, cum, total))
    assert got == want


def test_running_total_over_many_ranges(spark):
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("v"), F.lit(2).cast("long").alias("w"), F.lit("x").alias("tag"))
    out = Q.running_total(df.repartition(7), "v", "w")
    assert out.columns == ["v", "w", "tag", "cum", "total"]
    got = [r["cum"] for r in out.orderBy("v").collect()]
    assert got == list(range(2, 40_001, 2)) and out.select("total").distinct().count() == 1
    assert Q.running_total(df.where("false"), "v", "w").count() == 0


def test_median_by_running_total(spark):
    rng = np.random.default_rng(3)
    for values in (np.exp(rng.normal(0, 9, 4001)), np.array([5.0]), np.array([1.0, 2.0]), rng.integers(0, 3, 500) * 1.0):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        row = Q.median(df, "v").first()
        assert row["n"] == len(values) and row["q1"] == pytest.approx(np.median(values), rel=1e-12)


def crowded(n=40_000):
    """Values of which far over half of the distinct ones lie in a 256th of the values' range, and of the ranks of all groups."""
    rng = np.random.default_rng(11)
    near = 1000 + np.unique(rng.random(n)) / 1000
    return np.concatenate([rng.random(n // 10) * 1e9, near, np.full(n, -3.0)])


def test_selection_cuts_where_the_values_are(spark, monkeypatch):
    """One fixed range would hold over half of the distinct values; rounds go on until none holds more than asked."""
    monkeypatch.setattr(Q, "SMALL", 200)
    monkeypatch.setattr(Q, "PIECES", 8)
    rounds = []
    narrowed = Q._narrowed
    monkeypatch.setattr(Q, "_narrowed", lambda *a: rounds.append(1) or narrowed(*a))
    values = crowded()
    df = spark.createDataFrame([("crowd", float(v)) for v in values] + [("few", float(k)) for k in range(5)], "g string, v double")
    got = {r["g"]: r for r in Q.exact_quantiles(df, "v", PROBS, ["g"]).collect()}
    for i, p in enumerate(PROBS, 1):
        assert got["crowd"][f"q{i}"] == pytest.approx(np.quantile(values, p), rel=1e-12)
        assert got["few"][f"q{i}"] == pytest.approx(4 * p)
    assert len(rounds) >= 3


def test_rounds_end_where_nothing_parts_the_values(spark, monkeypatch):
    monkeypatch.setattr(Q, "SMALL", 1)
    df = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,), (2.0,)], "v double")
    assert Q.exact_quantiles(df, "v", [0.0, 0.4]).first()["q1"] == 1.0


def test_many_variables_share_one_scan(spark, tmp_path):
    n = 3000
    rng = np.random.default_rng(5)
    data = {f"v{k}": rng.normal(k, 1 + k, n) for k in range(5)}
    rows = [("ab"[i % 2] if i % 7 else None, *(float(data[f"v{k}"][i]) for k in range(5))) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"v{k} double" for k in range(5)))
    df.write.parquet(f"{tmp_path}/t")
    scans = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            scans.add(batch.num_rows)
            yield batch

    base = spark.read.parquet(f"{tmp_path}/t").mapInArrow(counted, df.schema)
    got = {(r["variable"], r["g"], r["is_overall"]): r for r in Q.quantiles_of_many(base, list(data), [0.5], ["g"], overall=True).collect()}
    assert scans.value == n
    assert len(got) == 5 * 4
    for v, values in data.items():
        assert got[v, None, 1]["q1"] == pytest.approx(np.median(values), rel=1e-12)
        own = [x for x, r in zip(values, rows, strict=True) if r[0] is None]
        assert got[v, None, 0]["q1"] == pytest.approx(np.median(own), rel=1e-12)


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert Q.exact_quantiles(df, "v", [0.5], ["g"]).count() == 0


def test_approx_close_to_exact(spark):
    df = spark.range(10_000).select(F.col("id").cast("double").alias("v"))
    row = Q.approx_quantiles(df, "v", [0.25, 0.5]).first()
    assert row["n"] == 10_000 and abs(row["q1"] - 2500) <= 2 and abs(row["q2"] - 5000) <= 2
