"""The driver contract, and the SQL twins of a cross-section of the queries."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_module
from panelyst.queries import all_queries
from tools.check import TABLES, norm

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "one_factor_lump",
    "many_binary_lump",
    "continuous_mean",
    "continuous_median",
    "group_sizes",
    "token_in_text",
    "null_predicates",
    "drop_all_zero",
    "recode_override",
    "dummy_code",
    "multi_select_flags",
    "link_waves",
    "rekey_subgroup",
    "visit_in_window",
    "scale_score_reversed",
    "item_prevalence_by_group",
    "category_prevalence",
    "share_of_group",
    "chi_square_yates",
    "chi_square_of_table",
    "csv_na_scan",
    "codebook",
]


def test_contract(spark):
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_sql_twin(spark, name):
    fn, sql = all_queries()[name]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    df = fn(spark, SF)
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(norm(v) for v in r) for r in cursor.fetchall())
    got = sorted(tuple(norm(r[c]) for c in names) for r in df.collect())
    assert got == want
