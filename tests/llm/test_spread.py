"""Large groups and large files are the work of many tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelyst.llm import minhash, places, suffixes


def test_side_tables_by_ranges_of_rows(spark, frame, monkeypatch):
    rows = [(k, f"{k} " + "shared passage of some length " * (k % 3)) for k in range(200)]  # strings shorter than those that windows are filed under
    want = sorted(map(tuple, suffixes.remove_repeats(frame(rows, partitions=1), 40).collect()))
    monkeypatch.setattr(places, "RANGE", 7)
    assert sorted(map(tuple, suffixes.remove_repeats(frame(rows, partitions=1), 40).collect())) == want
    located = places.located(frame(rows, partitions=1), [F.col("doc_id"), F.col("text")], False)
    path = places.by_file(located.select("file", "row"), "side")
    assert spark.read.parquet(path).select("file", "range").distinct().count() == 29


def test_repeated_keys_are_joined_without_writing_them(spark, frame, monkeypatch):
    """A task that writes a file starts other processes for it, so only tables that are read twice are written."""
    written = []
    materialise = suffixes.materialise
    monkeypatch.setattr(suffixes, "materialise", lambda df, name: written.append(name) or materialise(df, name))
    suffixes.remove_repeats(frame([(k, f"{k} " + "a passage that repeats " * (k % 4)) for k in range(20)]), 30).count()
    assert written == ["runs", "kinds", "contexts", "cells", "wholes", "windows"]


@pytest.mark.parametrize("whole", [True, False])
def test_rows_of_a_very_common_key_are_split(spark, whole):
    key = F.col("key") if whole else F.struct(F.col("key").alias("h1"), (F.col("key") % 7).alias("h2"))
    rows = spark.range(0, 40_000, 1, 8).select("id", F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 8000).cast("long").alias("key"))
    rows = rows.unionByName(spark.range(40_000, 40_100).select("id", F.col("id").alias("key"))).withColumn("key", key)
    tuned = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in tuned}
    for k, v in tuned.items():
        spark.conf.set(k, v)
    try:
        found = suffixes._of_several(rows, rows, "key", whole)
        got = sorted(r["id"] for r in found.collect())
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert found.columns == rows.columns and got == list(range(40_000))
    assert "skew=true" in plan


@pytest.mark.parametrize("odd", [0, 3])
def test_what_is_linked_to_the_head_does_not_meet(spark, odd):
    """Of 500 members 500 - odd are linked to the head: only pairs with one of the odd ones are looked at."""
    members = spark.range(500).select(F.lit(0).cast("long").alias("hub"), F.col("id").alias("cid"))
    payload = spark.range(500).select(F.col("id").alias("cid"), (F.col("id") >= 500 - odd).cast("int").alias("kind"))
    rows = []

    def alike(own, head):
        return [a == b for a, b in zip(own.to_pylist(), head.to_pylist(), strict=True)]

    def judge(ids, kinds, side, one_block):
        assert 1 in kinds.to_pylist(), "a block without an odd one"
        return minhash._edges(ids, minhash.Union(len(ids)))

    edges = minhash._meet(members, "hub", payload, "kind", alike, judge, 50)
    rows = sorted(map(tuple, edges.collect()))
    assert rows == [(k, 0) for k in range(1, 500 - odd)]
