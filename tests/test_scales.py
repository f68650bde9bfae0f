from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelyst.operators.scales import Scale, clean_items, cronbach_alpha, score_scales

ROWS = [(1, 2, 3), (1, None, 3), (None, None, None), (98, 2, 3), (98, 98, 98), (0, 0, 0)]


@pytest.mark.parametrize(
    "scale, expected",
    [
        (Scale("s", ("a", "b", "c"), 4), [6, 4, None, 5, None, 0]),
        (Scale("s", ("a", "b", "c"), 4, skip_null=False), [6, None, None, None, None, 0]),
        (Scale("s", ("a", "b", "c"), 4, all_missing=0), [6, 4, 0, 5, 0, 0]),
        (Scale("s", ("a", "b", "c"), 4, reverse={"c": 7}), [7, 5, None, 6, None, 7]),
        (Scale("s", ("a", "b", "c"), 4, remap={98: 0}), [6, 4, None, 5, 0, 0]),
    ],
)
def test_policies(spark, scale, expected):
    df = spark.createDataFrame(ROWS, "a int, b int, c int")
    assert [r["s"] for r in score_scales(df, [scale]).collect()] == expected


def test_shared_item_needs_one_rule(spark):
    df = spark.createDataFrame(ROWS, "a int, b int, c int")
    with pytest.raises(ValueError, match="two ways"):
        score_scales(df, [Scale("s", ("a", "b"), 4), Scale("t", ("b", "c"), 5)])


def test_alpha_matches_pairwise_covariances(spark):
    df = spark.range(200).select(
        *[
            F.when(F.col("id") % (11 + i) != 0, (F.col("id") * (i + 2) % 7 + F.col("id") % 5).cast("int")).alias(f"q{i}")
            for i in range(4)
        ]
    )
    scale = Scale("s", ("q0", "q1", "q2", "q3"), 50, "Four")
    got = cronbach_alpha(clean_items(df, [scale]), [scale]).first()
    cov = df.toPandas().astype("float64").cov()  # pandas uses pairwise-complete rows
    total, trace = cov.values.sum(), cov.values.diagonal().sum()
    assert got["alpha"] == pytest.approx(4 / 3 * (1 - trace / total), rel=1e-10)
    assert (got["scale"], got["n_items"], got["items"]) == ("Four", 4, "q0_RC, q1_RC, q2_RC, q3_RC")


def test_many_alphas_at_once(spark):
    df = spark.range(50).select(*[(F.col("id") * (i + 1) % 6).cast("int").alias(f"q{i}") for i in range(5)])
    scales = [Scale("s", ("q0", "q1", "q2"), 9), Scale("t", ("q3", "q4"), 9)]
    both = cronbach_alpha(clean_items(df, scales), scales).collect()
    for scale, row in zip(scales, both):
        alone = cronbach_alpha(clean_items(df, [scale]), [scale]).first()
        assert row["alpha"] == pytest.approx(alone["alpha"], rel=1e-12) and row["items"] == alone["items"]
