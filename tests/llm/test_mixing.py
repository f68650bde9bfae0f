from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from panelyst.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def documents(n=3000, seed=1):
    rng = random.Random(seed)
    names = ["b", "a", "B", "é", None, "", "tiny", "hot"]
    rows = []
    for k in range(n):
        source = rng.choices(names, [4, 4, 4, 4, 4, 4, 0.3, 20])[0]
        rows.append((k, "w " * min(int(rng.paretovariate(1.1) * 8), 4000), source))
    return rows


def targets(sizes):
    """Exact shares: sources by code point, NULL last, weights 5, 2, 1; capped at three times the size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else share[s] for s in order}
        capped |= over


@pytest.fixture(scope="module")
def mixed(spark):
    rows = documents()
    return rows, mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()


def test_targets(mixed):
    rows, out = mixed
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t))
    want = targets(sizes)
    for r in out:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]


def test_taken_words_come_near_the_target(mixed):
    rows, out = mixed
    assert sorted(r["doc_id"] for r in out) == [r[0] for r in rows]
    taken, target = defaultdict(int), {}
    for r in out:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        share = r["target"] / r["source_size"]
        assert r["copies"] in (int(share), int(np.ceil(share)))
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.01 * t, 60), s


def test_reruns_agree_whatever_the_partitions(spark, mixed):
    rows, out = mixed
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(2)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in out) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_small_buckets_make_a_deep_tree(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 4)
    rows = documents(600, 2)
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 600
    taken, target = defaultdict(int), {}
    for r in out:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    largest = defaultdict(int)
    for r in out:
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in target:  # all that is left over in the end is part of one document
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1


def test_odd_rows(frame):
    rows = [(1, None, None), (1, None, None), (2, "", "a"), (None, "x y", "a"), (None, "x y", "a"), (4, "w " * 50_000, "c")]
    out = mixing.mix(frame(rows, SCHEMA)).collect()
    assert len(out) == 6 and sorted(r["size"] for r in out) == [0, 0, 0, 2, 2, 50_000]
    assert all(r["taken"] == 0 for r in out if r["size"] == 0)
    assert mixing.mix(frame(rows, SCHEMA).where("false")).count() == 0
    blank = mixing.mix(frame([(1, " ", "a"), (2, None, "b")], SCHEMA)).collect()
    assert [(r["target"], r["taken"]) for r in blank] == [(0.0, 0)] * 2


def test_every_document_is_taken_its_share_of_times_on_average():
    size = np.array([50.0, 30, 20, 20, 10, 5, 5, 1])
    part = np.full(8, 0.3)
    got = np.zeros(8)
    for seed in range(4000):
        out, held = mixing.settle(size, part, np.random.default_rng(seed))
        assert abs((out * size).sum() - (part * size).sum()) < 1e-9
        assert all(o in (0.0, 1.0) for k, o in enumerate(out) if k != held)
        got += out
    assert np.abs(got / 4000 - 0.3).max() < 0.04


def test_landing_brings_the_sum_nearer():
    size, part = np.array([100.0, 40, 30, 10]), np.array([0.4, 0.0, 0.0, 1.0])
    out = mixing.land(size, part, 0)
    assert set(out) <= {0.0, 1.0} and abs((out * size).sum() - 50) <= 10


def test_equal_rows_part_into_buckets(spark, monkeypatch):
    """A row that repeats more often than a bucket holds is settled in many buckets, and runs keep its number."""
    monkeypatch.setattr(mixing, "RUN", 7)
    rows = [(5, "a", "same words here")] * 40 + [(None, None, None)] * 3 + [(k, "b", "w " * k) for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    told = mixing._told_apart(df.select("doc_id", "source", F.xxhash64("doc_id", "text").alias("tie")))
    assert told.count() == len(rows) and told.distinct().count() == len(rows)
    monkeypatch.setattr(mixing, "BUCKET", 8)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)
