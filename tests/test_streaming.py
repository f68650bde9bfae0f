from __future__ import annotations

from pyspark.sql import functions as F

from panelyst.operators import clean, recode
from panelyst.operators.scales import Scale, score_scales


def test_projections_run_on_a_stream(spark, tmp_path):
    """Cleaning, recoding and scoring are stateless, so a stream of files can use them."""
    src = spark.createDataFrame([(1, 1, 2, "....."), (2, 98, 3, "ok"), (3, 98, 98, None)], "g int, a int, b int, t string")
    src.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).parquet(f"{tmp_path}/in")
    out = score_scales(clean.token_to_null(stream), [Scale("s", ("a", "b"), 9)])
    out = out.withColumn("grp", recode.recode("g", {1: "one"}))
    query = (
        out.writeStream.format("memory").queryName("scored").option("checkpointLocation", f"{tmp_path}/cp").start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.table("scored").orderBy(F.col("g")).collect()
    assert [(r["s"], r["t"], r["grp"]) for r in got] == [(3, None, "one"), (3, "ok", "2"), (None, None, "3")]
