"""Bounded samples of rows to fit a classifier on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyst.sources.sinks import materialise

SCALE = 1 << 40
#: Rows of a whole sample; where strata are many each has fewer, but FEWEST of them in any case.
MOST_ROWS, FEWEST = 25_600, 4
#: Parts of a stratum of long texts only, of which each gives its shortest.
PARTS = 16


def candidates(rows: DataFrame, most_bytes: int) -> DataFrame:
    """One row with mark, hash, long and size for each id, and stratum if there is one, of rows with a text.

    Of several texts of an id one of up to ``most_bytes`` is taken, or else, marked as ``long``, the shortest.
    """
    keys = [c for c in ("doc_id", "stratum") if c in rows.columns]
    size = F.octet_length("text")
    order = F.struct(
        (size > most_bytes).alias("long"), F.when(size > most_bytes, size).otherwise(0).alias("size"), F.xxhash64("text").alias("hash")
    )
    found = rows.select(*keys, order.alias("r")).groupBy(*keys).agg(F.min("r").alias("r"))
    return found.select(*keys, F.pmod(F.xxhash64("doc_id"), F.lit(SCALE)).alias("mark"), "r.*")


def bounded_sample(found: DataFrame, per_stratum: int, kind: str = "string", most_rows: int = MOST_ROWS) -> list[tuple]:
    """Up to ``per_stratum`` (doc_id, stratum, hash) of every stratum of the candidates, however many strata there are.

    The same at every run: those whose ids hash lowest. A stratum is thinned by its share before anything is
    collected. One with fewer than FEWEST short texts adds the shortest of its long ones.
    """
    sizes = found.groupBy("stratum").agg(F.count_if(~F.col("long")).alias("n")).collect()  # a row for each stratum
    if not sizes:
        return []
    each = max(FEWEST, min(per_stratum, most_rows // len(sizes)))
    cuts = [(s, int(min(1.0, (1.5 * each + 20) / max(n, 1)) * SCALE), n < FEWEST) for s, n in sizes]
    limits = F.broadcast(found.sparkSession.createDataFrame(cuts, f"stratum {kind}, cut long, few boolean"))
    marked = found.join(limits, "stratum")
    short = marked.where("not long and mark < cut").select("mark", "doc_id", "stratum", "hash")
    part = F.pmod(F.xxhash64("doc_id", "hash"), F.lit(PARTS))
    shortest = F.min(F.struct("size", "mark", "doc_id", "hash")).alias("r")
    long = marked.where("long and few").groupBy("stratum", part.alias("part")).agg(shortest).select("stratum", "r.*").collect()
    taken: dict[object, int] = {}
    out = []
    for r in sorted(short.collect(), key=lambda r: (r["mark"], r["doc_id"], str(r["stratum"]))):
        taken[r["stratum"]] = taken.get(r["stratum"], 0) + 1
        if taken[r["stratum"]] <= each:
            out.append((r["doc_id"], r["stratum"], r["hash"]))
    for r in sorted(long, key=lambda r: (r["size"], r["mark"], r["doc_id"], str(r["stratum"]))):
        taken[r["stratum"]] = taken.get(r["stratum"], 0) + 1
        if taken[r["stratum"]] <= FEWEST:
            out.append((r["doc_id"], r["stratum"], r["hash"]))
    return out


def sample_texts(rows: DataFrame, per_stratum: int, most_bytes: int, kind: str, marks: DataFrame | None = None) -> pa.Table:
    """(doc_id, stratum, text) of a bounded sample of (doc_id, stratum, text), one row for an id and stratum, in order.

    Rows of (doc_id, text) take their strata from ``marks``, (doc_id, stratum) with one row for an id.
    """
    found = candidates(rows, most_bytes)
    found = materialise(found if marks is None else found.join(marks, "doc_id"), "candidates")
    ids = rows.sparkSession.createDataFrame(bounded_sample(found, per_stratum, kind), f"doc_id long, stratum {kind}, hash long")
    on = ["doc_id", "hash"] if marks is not None else ["doc_id", "stratum", "hash"]
    joined = rows.withColumn("hash", F.xxhash64("text")).join(F.broadcast(ids), on)  # as many ids as were picked
    one_each = joined.select("doc_id", "stratum", "hash", "text").dropDuplicates(["doc_id", "stratum", "hash"]).drop("hash")
    return one_each.toArrow().sort_by([("doc_id", "ascending"), ("stratum", "ascending"), ("text", "ascending")])
