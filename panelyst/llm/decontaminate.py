"""Benchmark decontamination: short test items found inside long documents.

Items are partitioned by their number of distinct shingles, n of up to u = 2^partition - 1. The partition fixes the
length of the MinHash sketches of its items: the u - ceil(t u) + 1 smallest hashes, of which a document must have one
that contains a share t of the item. Each partition is searched on its own: documents with too few shingles for its
smallest items are passed over, the others probed for hashes of its sketches; where one is met, the shingles that the
partition's items have go on, and containment is counted on the full sets. The search so misses nothing.

Documents are probed against bit maps of BITS places, which Spark makes and which have one size however many
items there are. A hash that only seems to be there costs a row and is dropped by the join.

Items of fewer than five words are one shingle of all their words, so only documents of just these words hold them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyst.llm import textops

#: Places of each of the two bit maps (8 MB each) that go to every task; a power of two, 32,768 or more.
BITS = 1 << 26
#: Spark's bitmap functions cut places, counted from 1, into buckets of so many.
BUCKET = 1 << 15


def places_of(shingles: np.ndarray, partition: int | np.ndarray, bits: int) -> np.ndarray:
    """Where the shingles of items of a partition stand in a bit map."""
    seed = np.asarray(partition).astype(np.uint64) * np.uint64(textops.BASE)
    return (textops.mix(shingles ^ seed) & np.uint64(bits - 1)).astype(np.int64)


def item_sketches(items: DataFrame, percent: int = 75, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, partition, n_item_shingles, shingle, in_sketch, place): a row for each distinct shingle of each item.

    ``partition`` is the number of binary digits of the set's size. Items without words have no rows; ids may be
    NULL, and rows that repeat are items each, told apart by ``item``.
    """
    bits = BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, "text"):
                sets = textops.shingle_sets(part.column("text"))
                n = np.array([len(s) for s in sets], np.int64)
                partition = np.array([int(k).bit_length() for k in n], np.int32)
                most = (np.int64(1) << partition.astype(np.int64)) - 1
                kept = most - (percent * most + 99) // 100 + 1
                at = np.repeat(np.arange(len(sets)), n)
                first = np.repeat(np.cumsum(n) - n, n)
                rank = np.arange(len(at)) - first  # a set is sorted: its first hashes are the smallest
                shingle = np.concatenate([np.empty(0, np.uint64), *sets])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("item").take(pa.array(at)),
                        part.column("item_id").take(pa.array(at)),
                        pa.array(partition[at]),
                        pa.array(n[at]),
                        pa.array(shingle.view(np.int64)),
                        pa.array(rank < kept[at]),
                        pa.array(places_of(shingle, partition[at], bits)),
                    ],
                    ["item", "item_id", "partition", "n_item_shingles", "shingle", "in_sketch", "place"],
                )

    rows = items.select(
        F.monotonically_increasing_id().alias("item"),
        F.col(id_col).cast("long").alias("item_id"),
        F.col(text_col).cast("string").alias("text"),
    )
    return rows.mapInArrow(
        run, "item long, item_id long, partition int, n_item_shingles long, shingle long, in_sketch boolean, place long"
    )


def _bit_map(places: DataFrame, bits: int) -> np.ndarray:
    """A bit for each place that is in the column ``place``."""
    place = F.col("place") + 1
    found = places.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    out = np.zeros((bits // BUCKET, BUCKET // 8), np.uint8)
    for row in found.toLocalIterator():  # at most bits / BUCKET rows of 4 KB
        out[row["bucket"] - 1] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _has(bit_map: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bit_map[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def leaks(docs: DataFrame, items: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, text_hash, item_id, n_item_shingles, n_shared, containment): documents with ``percent`` of an item.

    ``items`` is a written result of ``item_sketches``. Words and shingles are those of the near-duplicate
    operators: A-Z in lower case, five words, a shorter text being one shingle. NULL or empty texts hold
    nothing and are contained in nothing. ``row`` tells rows apart whose ids repeat or are NULL, and
    ``text_hash`` is the xxhash64 of the text. Without documents or items there are no rows.
    """
    bits = BITS
    partitions = sorted(r[0] for r in items.select("partition").distinct().collect())  # binary digits of a count
    maps = docs.sparkSession.sparkContext.broadcast((_bit_map(items.where("in_sketch"), bits), _bit_map(items, bits)))
    names = ["row", "doc_id", "text_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches, known = maps.value
        for batch in batches:
            for part in textops.slices(batch, "text"):
                data, offsets = textops.text_bytes(part.column("text"))
                hashes, _, begin = textops.words(data, offsets, fold=True)
                all_flat, at = textops.shingles(hashes, begin)
                count = np.diff(at)
                all_of = np.repeat(np.arange(len(part)), count)
                for partition in partitions:
                    # of an item with n shingles a document must have percent; n is 2^(partition - 1) or more
                    large = 100 * count >= percent << (partition - 1)
                    flat, of = (all_flat, all_of) if large.all() else (all_flat[large[all_of]], all_of[large[all_of]])
                    place = places_of(flat, partition, bits)
                    met = np.zeros(len(part), bool)
                    met[of[_has(sketches, place)]] = True
                    if not met.any():
                        continue
                    stays = met[of]
                    stays[stays] = _has(known, place[stays])
                    flat, of = flat[stays], of[stays]
                    order = np.lexsort((flat, of))
                    flat, of = flat[order], of[order]
                    first = np.append(True, (flat[1:] != flat[:-1]) | (of[1:] != of[:-1]))[: len(flat)]
                    take = pa.array(of[first])
                    number = pa.array(np.full(len(take), partition, np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c).take(take) for c in names), number, pa.array(flat[first].view(np.int64))],
                        [*names, "partition", "shingle"],
                    )

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
        F.col(text_col).cast("string").alias("text"),
    )
    hits = rows.mapInArrow(run, "row long, doc_id long, text_hash long, partition int, shingle long")
    pairs = (
        hits.join(items.drop("place"), ["partition", "shingle"])
        .groupBy(*names, "item", "item_id", "n_item_shingles")
        .agg(F.count(F.lit(1)).alias("n_shared"), F.max("in_sketch").alias("met"))
    )
    return pairs.where(F.col("met") & (F.col("n_shared") * 100 >= F.col("n_item_shingles") * percent)).select(
        *names,
        "item_id",
        "n_item_shingles",
        "n_shared",
        (F.col("n_shared") / F.col("n_item_shingles")).alias("containment"),
    )
