"""Item and category prevalence, overall and by group."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyst.operators import prevalence as P
from panelyst.queries.base import RETURNED, returned_items, table

Q = P.Question
CATALOG = [
    Q("R1", "Health", "Diet", "Lifetime"),
    Q("R2", "Health", "Exercise", "Lifetime"),
    Q("R3", "Health", "Diet", "Last 6 Months"),
    Q("R4", "Work", "Search", "Lifetime"),
    Q("R5", "Work", "Search", "Last 6 Months"),
    Q("R6", "Work", "Training", "Last 6 Months"),
    Q("R7", "Work", "Listed only", "Lifetime", in_any=False),
]


def _answers(spark, sf):
    items = returned_items(spark, sf)
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("grp"))
    return items.join(o, F.col("l_orderkey") == F.col("o_orderkey"))


_ANSWERS = f"""SELECT r.*, o_orderpriority AS grp FROM ({RETURNED}) r JOIN orders ON l_orderkey = o_orderkey"""


def _items(groups, denominator="max_answered", any_rows=True):
    def run(spark, sf):
        return P.item_prevalence(_answers(spark, sf), CATALOG, groups, denominator, any_rows)

    return run


def _categories(groups):
    def run(spark, sf):
        return P.category_prevalence(_answers(spark, sf), CATALOG, groups)

    return run


def _cats(catalog: list[P.Question]) -> dict[tuple[str, str], list[str]]:
    out: dict[tuple[str, str], list[str]] = {}
    for q in catalog:
        if q.in_any:
            out.setdefault((q.category, q.facet), []).append(q.variable)
    return out


# Round half up on the decimal value, which is what Spark's round does.
_PROP = "CASE WHEN total > 0 THEN CAST(round(CAST(n AS DECIMAL(18, 0)) * 1000 / total) / 1000 AS DOUBLE) END AS proportion"


def items_sql(
    answers: str,
    catalog: list[P.Question],
    group: str | None = None,
    denominator: str = "max_answered",
    any_rows: bool = True,
) -> str:
    g, by = (f"{group}, ", f" GROUP BY {group}") if group else ("", "")
    most = "greatest(" + ", ".join(f"count({q.variable})" for q in catalog) + ")"
    parts = []
    for q in catalog:
        total = {"max_answered": most, "answered": f"count({q.variable})", "rows": "count(*)"}[denominator]
        parts.append(
            f"""SELECT {g}'{q.variable}' AS variable, '{q.category}' AS category, '{q.topic}' AS topic,
  '{q.facet}' AS facet, count(*) FILTER (WHERE {q.variable} = 1) AS n, {total} AS total FROM a{by}"""
        )
    if any_rows:
        for (cat, facet), items in _cats(catalog).items():
            cond = " OR ".join(f"{i} = 1" for i in items)
            parts.append(
                f"""SELECT {g}'{cat} / {facet}', '{cat}', 'Any of these', '{facet}',
  count(*) FILTER (WHERE {cond}), count(*) FROM a{by}"""
            )
    return f"WITH a AS ({answers}), s AS ({' UNION ALL '.join(parts)}) SELECT *, {_PROP} FROM s"


def categories_sql(answers: str, catalog: list[P.Question], group: str | None = None) -> str:
    g, by = (f"{group}, ", f" GROUP BY {group}") if group else ("", "")
    parts = []
    for (cat, facet), items in _cats(catalog).items():
        total = " + ".join(f"CAST({i} = 1 AS INTEGER)" for i in items)
        parts.append(
            f"""SELECT {g}'{cat} / {facet}' AS variable, '{cat}' AS category, '{facet}' AS facet,
  count(*) FILTER (WHERE {total} > 0) AS n, count({total}) AS total FROM a{by}"""
        )
    return f"WITH a AS ({answers}), s AS ({' UNION ALL '.join(parts)}) SELECT *, {_PROP} FROM s"


QUERIES = {
    "item_prevalence": (_items([]), items_sql(_ANSWERS, CATALOG)),
    "item_prevalence_by_group": (_items(["grp"]), items_sql(_ANSWERS, CATALOG, "grp")),
    "item_prevalence_rows": (_items([], "rows", False), items_sql(_ANSWERS, CATALOG, None, "rows", False)),
    "item_prevalence_rows_by_group": (_items(["grp"], "rows", False), items_sql(_ANSWERS, CATALOG, "grp", "rows", False)),
    "item_prevalence_answered": (_items([], "answered", False), items_sql(_ANSWERS, CATALOG, None, "answered", False)),
    "category_prevalence": (_categories([]), categories_sql(_ANSWERS, CATALOG)),
    "category_prevalence_by_group": (_categories(["grp"]), categories_sql(_ANSWERS, CATALOG, "grp")),
}
