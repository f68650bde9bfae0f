"""Scale scores under each missing-item policy, and reliability."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyst.operators.scales import Scale, clean_items, cronbach_alpha, score_scales
from panelyst.queries.base import BATTERY, battery, round_cols

SKIP = Scale("skip", ("I1", "I2", "I3"), 45, "Skip")
STRICT = Scale("strict", ("I1", "I2"), 45, "Strict", skip_null=False)
ZERO = Scale("zero", ("I4", "I5"), 40, "Zero", all_missing=0)
REVERSED = Scale("reversed", ("I5", "I6", "I7"), 48, "Reversed", reverse={"I7": 49})
TAIL = Scale("tail", ("I6", "I7"), 48, "Tail", reverse={"I7": 49})
REMAPPED = Scale("remapped", ("I6", "I7"), 40, "Remapped", remap={50: 0})


def _score(scale: Scale):
    def run(spark, sf):
        return score_scales(battery(spark, sf), [scale]).select("l_orderkey", scale.name)

    return run


def _item_sql(s: Scale, i: str) -> str:
    base = i
    for old, new in s.remap.items():
        base = f"CASE WHEN {i} = {old} THEN {new} ELSE {base} END"
    out = f"CASE WHEN ({base}) <= {s.max_valid} THEN ({base}) END"
    return f"({s.reverse[i]} - ({out}))" if i in s.reverse else f"({out})"


def _score_sql(s: Scale) -> str:
    items = [_item_sql(s, i) for i in s.items]
    total = " + ".join(f"coalesce({i}, 0)" if s.skip_null else i for i in items)
    empty = "NULL" if s.all_missing is None else str(s.all_missing)
    return f"""SELECT l_orderkey, CASE WHEN coalesce({", ".join(items)}) IS NULL THEN {empty}
  ELSE {total} END AS {s.name} FROM ({BATTERY})"""


def scale_items(spark, sf):
    return clean_items(battery(spark, sf), [REVERSED]).select("l_orderkey", "I5_RC", "I6_RC", "I7_RC")


def score_many(spark, sf):
    scales = [SKIP, ZERO, TAIL]
    return score_scales(battery(spark, sf), scales).select("l_orderkey", *[s.name for s in scales])


_ALPHA = [
    Scale("a", ("I1", "I2", "I3", "I4", "I5", "I6", "I7"), 15, "All"),
    Scale("b", ("I1", "I2"), 12, "Pair"),
]


def _related(spark, sf):
    """Make the items of an order resemble each other, so that alpha is well above 0."""
    b = battery(spark, sf)
    return b.withColumns({f"I{i}": F.col(f"I{i}") % 10 + (F.col("l_orderkey") % 7).cast("int") for i in range(1, 8)})


_RELATED = (
    "SELECT l_orderkey, "
    + ", ".join(f"CAST(I{i} % 10 + l_orderkey % 7 AS INTEGER) AS I{i}" for i in range(1, 8))
    + f" FROM ({BATTERY})"
)


def cronbach_alpha_query(spark, sf):
    return round_cols(cronbach_alpha(_related(spark, sf), _ALPHA, raw=True), 6, "alpha")


def _alpha_sql(items: tuple[str, ...], max_valid: int, label: str) -> str:
    cl = [f"CASE WHEN {i} <= {max_valid} THEN {i} END" for i in items]
    var = " + ".join(f"var_samp({c})" for c in cl)
    cov = " + ".join(f"covar_samp({cl[a]}, {cl[b]})" for a in range(len(cl)) for b in range(a + 1, len(cl)))
    k = len(items)
    return f"""SELECT '{label}' AS scale, round({k}::DOUBLE / {k - 1} * (1 - v / (v + 2 * c)), 6) AS alpha,
  {k} AS n_items, '{", ".join(i + "_RC" for i in items)}' AS items
  FROM (SELECT {var} AS v, {cov} AS c FROM ({_RELATED}))"""


QUERIES = {
    "scale_score_skip_null": (_score(SKIP), _score_sql(SKIP)),
    "scale_score_null_if_any": (_score(STRICT), _score_sql(STRICT)),
    "scale_score_zero_if_all": (_score(ZERO), _score_sql(ZERO)),
    "scale_score_reversed": (_score(REVERSED), _score_sql(REVERSED)),
    "scale_score_remapped": (_score(REMAPPED), _score_sql(REMAPPED)),
    "scale_items": (
        scale_items,
        "SELECT l_orderkey, "
        + ", ".join(f'{_item_sql(REVERSED, i)} AS "{i}_RC"' for i in REVERSED.items)
        + f" FROM ({BATTERY})",
    ),
    "score_many": (
        score_many,
        f"SELECT * FROM ({_score_sql(SKIP)}) JOIN ({_score_sql(ZERO)}) USING (l_orderkey) "
        f"JOIN ({_score_sql(TAIL)}) USING (l_orderkey)",
    ),
    "cronbach_alpha": (
        cronbach_alpha_query,
        " UNION ALL ".join(_alpha_sql(s.items, s.max_valid, s.label) for s in _ALPHA),
    ),
}
