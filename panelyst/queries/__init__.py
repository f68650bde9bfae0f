"""Registered queries over the driver tables, each next to its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, tuple[Query, str | None]]:
    from panelyst.queries import (
        cleaning,
        files,
        groups,
        linkage,
        prevalence,
        recoding,
        scoring,
        study,
        tables,
        tests,
    )

    out: dict[str, tuple[Query, str | None]] = {}
    for module in (tables, cleaning, recoding, linkage, scoring, prevalence, groups, tests, files, study):
        for name, pair in module.QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} registered twice")
            out[name] = pair
    return out
