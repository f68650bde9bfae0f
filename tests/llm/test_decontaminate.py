from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from panelyst.llm import decontaminate
from panelyst.sources.sinks import materialise
from test_minhash import shingle_set


def planted():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("aeioustr") for _ in range(5)) for _ in range(300)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(2, 60))) for _ in range(20)]
    docs = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 400))]
        for _ in range(rng.randrange(3)):
            piece = rng.choice(items).split()
            for _ in range(rng.randrange(3)):
                piece[rng.randrange(len(piece))] = "edit"
            at = rng.randrange(len(words) + 1)
            words[at:at] = piece
        docs.append(" ".join(words))
    return docs + [None, "", items[0].upper(), items[0].upper()], items + ["", None, "a b", items[3]]


def run(spark, frame, docs, items):
    stored = materialise(decontaminate.item_sketches(frame(list(enumerate(items)), "item_id long, text string")), "items")
    out = decontaminate.leaks(frame([(k % 50, t) for k, t in enumerate(docs)]), stored)
    return sorted(tuple(r) for r in out.select("doc_id", "item_id", "n_item_shingles", "n_shared").collect())


def brute(docs, items):
    out = []
    for k, d in enumerate(docs):
        for i, t in enumerate(items):
            a, b = shingle_set(d), shingle_set(t)
            if b and 100 * len(a & b) >= 75 * len(b):
                out.append((k % 50, i, len(b), len(a & b)))
    return sorted(out)


def test_agrees_with_brute_force(spark, frame):
    docs, items = planted()
    assert run(spark, frame, docs, items) == brute(docs, items)


def taken(places, bits):
    out = np.zeros(bits, np.uint8)
    out[[r["place"] for r in places.select("place").collect()]] = 1
    return out


def test_partitions_fix_the_sketches(spark, frame):
    """All items of a partition have sketches of one length, or all of their shingles; the maps hold their places."""
    _, items = planted()
    stored = materialise(decontaminate.item_sketches(frame(list(enumerate(items)), "item_id long, text string")), "items")
    for r in stored.groupBy("item", "partition", "n_item_shingles").agg(F.count_if("in_sketch").alias("k")).collect():
        most = 2 ** r["partition"] - 1
        assert most // 2 < r["n_item_shingles"] <= most
        assert r["k"] == min(most - -(-75 * most // 100) + 1, r["n_item_shingles"])
    made = decontaminate._bit_map(stored, decontaminate.BITS)
    assert (np.unpackbits(made, bitorder="little") == taken(stored, decontaminate.BITS)).all()


def test_agrees_with_small_bit_maps(spark, frame, monkeypatch):
    """Maps in which nearly every place is taken pass on more rows and find the same."""
    docs, items = planted()
    monkeypatch.setattr(decontaminate, "BITS", 1 << 6)
    monkeypatch.setattr(decontaminate, "BUCKET", 1 << 6)
    monkeypatch.setattr(decontaminate, "_bit_map", lambda places, bits: np.packbits(taken(places, bits), bitorder="little"))
    assert run(spark, frame, docs, items) == brute(docs, items)


def test_empty_tables(spark, frame):
    empty = frame([(1, "x")], "item_id long, text string").where("false")
    items = materialise(decontaminate.item_sketches(empty), "items")
    assert decontaminate.leaks(frame([(1, "a b c d e")]), items).count() == 0
    some = materialise(decontaminate.item_sketches(frame([(1, "a b")], "item_id long, text string")), "items")
    assert decontaminate.leaks(frame([(1, "x")]).where("false"), some).count() == 0
