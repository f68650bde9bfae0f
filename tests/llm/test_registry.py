from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from panelyst.llm import registry

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operation():
    names = sorted(registry.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, len(names) + 1))
    assert {"pipeline", *names} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in registry.QUERIES.items() if sql))
def test_query_agrees_with_its_sql(spark, name):
    query, sql = registry.QUERIES[name]
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {table} as select * from read_parquet('{SF}/{table}.parquet')")
    df = query(spark, SF)
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(found.fetchall(), key=str)


def test_nothing_else_imports_this_subpackage():
    root = Path(entry.__file__).parent
    for path in (root / "panelyst").rglob("*.py"):
        if "llm" not in path.parts:
            assert "panelyst.llm" not in path.read_text()
    assert "panelyst.llm" in sys.modules
