"""Time queries on replicated tables, evenly and with one hot key.

    python tools/scale.py OUT_DIR COPIES [query ...]

Writes COPIES shifted copies of the sf0.1 tables under OUT_DIR (once), and a skewed
variant in which one customer has a third of all orders and one nation a third of
all customers, then prints the seconds per query for each.
"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F

from panelyst.queries import all_queries
from panelyst.session import local_session

SOURCE = "/root/testdata/sf0.1"
SHIFTED = {
    "customer": ("c_custkey",),
    "orders": ("o_orderkey", "o_custkey"),
    "lineitem": ("l_orderkey",),
}
DEFAULT = [
    "one_factor_table",
    "continuous_mean",
    "quantiles_by_group",
    "scale_score_skip_null",
    "item_prevalence",
    "first_value_by_date",
    "visit_in_window",
    "link_waves",
    "chi_square",
    "cronbach_alpha",
]


def build(spark, out: str, copies: int, skewed: bool) -> None:
    step = 10_000_000
    for name in ("region", "nation", "supplier", "part"):
        spark.read.parquet(f"{SOURCE}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    for name, keys in SHIFTED.items():
        df = spark.read.parquet(f"{SOURCE}/{name}.parquet")
        many = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        many = many.withColumns({k: F.col(k) + F.col("_copy") * step for k in keys}).drop("_copy")
        if skewed and name == "orders":
            many = many.withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(F.col("o_custkey")))
        if skewed and name == "customer":
            many = many.withColumn("c_nationkey", F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(F.col("c_nationkey")))
        many.write.parquet(f"{out}/{name}.parquet")


def main() -> None:
    root, copies, names = sys.argv[1], int(sys.argv[2]), sys.argv[3:] or DEFAULT
    spark = local_session(8, shuffle_partitions=32)
    dirs = {"x1": SOURCE}
    for label, skewed in ((f"x{copies}", False), (f"x{copies} skewed", True)):
        dirs[label] = f"{root}/{label.replace(' ', '_')}"
        if not os.path.exists(f"{dirs[label]}/lineitem.parquet/_SUCCESS"):
            build(spark, dirs[label], copies, skewed)
    for name in names:
        line = []
        for label, sf in dirs.items():
            best = None
            for _ in range(2):
                start = time.perf_counter()
                all_queries()[name][0](spark, sf).write.format("noop").mode("overwrite").save()
                took = time.perf_counter() - start
                best = took if best is None else min(best, took)
            line.append(f"{label}: {best:.2f} s")
        print(name, "|", ", ".join(line), flush=True)


if __name__ == "__main__":
    main()
