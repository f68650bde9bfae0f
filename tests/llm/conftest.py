from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A frame of documents in several partitions, with a column whose name operators use inside."""

    def make(rows, schema="doc_id long, text string", partitions=3):
        extra = ", n_bytes string, score string, `row` string, file string, hub int, size string"
        wide = [(*r, "x", "y", "z", "f", 7, "s") for r in rows]
        return spark.createDataFrame(wide, schema + extra).repartition(partitions)

    return make
