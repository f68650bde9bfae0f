from __future__ import annotations

import random
import re

import numpy as np
import pytest

from panelyst.llm import graph, minhash

UPPER = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(UPPER.get(c, c) for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                    up[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if root(k) == root(i) and rows[k][0] is not None]
        head = min(ids) if ids else None
        if not sets[i]:
            head = doc_id
        out.append((doc_id, len(sets[i]), head, doc_id == head))
    return out


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def documents(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioustr") for _ in range(5)) for _ in range(500)]
    rows = []
    for _ in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 300))]
        rows.append(" ".join(words))
        for _ in range(rng.randrange(6)):
            rows.append(edited(rng, words, rng.randrange(len(words) // 12)))
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows += [edited(rng, base, rng.randrange(9)) for _ in range(60)]  # a large group of close and less close copies
    rows += [rows[0], rows[0].upper(), "a b c", "A  b\tc", "a b d", "", None, "  \n", "one", "one"]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(k if k % 13 else None, rows[i]) for k, i in enumerate(order)]


@pytest.mark.parametrize("blocks", [(4096, 256), (8, 5)])
def test_agrees_with_brute_force(frame, blocks):
    rows = documents()
    got = minhash.near_duplicates(frame(rows), blocks=blocks)
    got = sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_equal_texts_under_one_id(frame):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "g h i j k l"), (2, "a b c d e f")]
    got = minhash.near_duplicates(frame(rows)).select("doc_id", "component_id", "kept")
    assert sorted(map(tuple, got.collect())) == [(1, 1, True)] * 3 + [(2, 1, False)]


def test_one_of_each(frame):
    rows = documents(2)
    df = frame(rows)
    out = minhash.one_of_each(df)
    assert out.columns == df.columns
    text_of = {}
    for doc_id, text in rows:
        text_of.setdefault(doc_id, text)
    groups = {}
    for (doc_id, _, head, _), (_, text) in zip(brute(rows), rows, strict=True):
        if head is not None and shingle_set(text):
            groups.setdefault(head, doc_id)
    kept = [r["doc_id"] for r in out.collect() if shingle_set(r["text"])]
    assert sorted(k for k in kept if k is not None) == sorted(groups)


def test_empty_table(frame):
    assert minhash.near_duplicates(frame([(1, "x")]).where("false")).count() == 0


def test_only_unlike_texts(frame):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(10)]
    assert all(r["kept"] for r in minhash.near_duplicates(frame(rows)).collect())


def test_signatures_agree_as_often_as_sets_do():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    a, b = np.sort(pool[:2600]), np.sort(pool[400:3000])
    same = (minhash.signatures([a, b])[0] == minhash.signatures([a, b])[1]).mean()
    assert abs(same - 2200 / 3000) < 0.2


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k + 1, k) for k in range(40)] + [(200, k) for k in range(100, 130)] + [(7, 7)]
    got = {r["a"]: r["b"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in [*range(101, 130), 200]}}
