"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores. Every query is run once to warm up and then BENCH_RUNS times
(default 2); its figure is the fastest run, all rows computed into a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from panelyst.queries import all_queries
from panelyst.session import local_session

HEADLINE = [
    "one_factor_table",
    "one_factor_many",
    "one_factor_lump",
    "many_binary_table",
    "continuous_mean",
    "continuous_median",
    "report_assembly",
    "token_in_text",
    "null_profile",
    "recode_map",
    "dummy_code",
    "multi_select_flags",
    "median_split",
    "link_waves",
    "rekey_subgroup",
    "first_value_by_date",
    "visit_in_window",
    "harmonise_versions",
    "scale_score_skip_null",
    "score_many",
    "cronbach_alpha",
    "item_prevalence",
    "item_prevalence_by_group",
    "category_prevalence_by_group",
    "quantiles_by_group",
    "chi_square",
    "welch_anova",
    "attrition_chi_square",
    "logit_wald",
    "binned_residuals",
    "csv_na_scan",
    "codebook_profile",
    "study_scales",
    "study_table1",
    "study_search_items",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    staging = tempfile.TemporaryDirectory(prefix="bench-")  # goes with the process
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench", staging.name)
    queries = all_queries()
    seconds: dict[str, float] = {}
    for name in names:
        fn = queries[name][0]
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            fn(spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times[1:]), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
