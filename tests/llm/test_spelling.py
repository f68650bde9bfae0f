from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from panelyst.llm import registry, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                p = h % len(run)
                run = run[:p] + run[p + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, least=3):
    n = {w: k for w, k in brute_counts(rows).items() if k >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out, key=str)


def words(rng, k):
    letters = "abcàéÿ×÷"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(k)]
    out = list(base)
    for w in base * 3:
        p = rng.randrange(len(w) + 1)
        out.append(rng.choice([w[:p] + rng.choice(letters) + w[p:], w[:p] + w[p + 1 :], w[:p] + rng.choice(letters) + w[p + 1 :]]))
    return [w for w in out if w]


def odd_rows(seed, n):
    rng = random.Random(seed)
    pool = words(rng, 40) + ["aaaaa", "aaaaaa", "aaaaaaa", "z" * 64, "z" * 65, "z" * 66, "é" * 40, "é" * 32]
    weight = [rng.choice([1, 2, 4, 9, 40]) for _ in pool]
    gap = [" ", "\n", ".", "1", "_", "ß ", "ā", "\x00", "漢"]
    rows = []
    for k in range(n):
        text = "".join(rng.choice([str.upper, str.title, str])(w) + rng.choice(gap) for w in rng.choices(pool, weight, k=rng.randint(0, 60)))
        rows.append((k, text))
    return [*rows, (None, "aaaaa " * 5), (None, "aaaaa " * 5), (n, None), (n + 1, ""), (n + 2, "quiet"), (-5, "long " * 9000 + "y" * 40_000)]


def query(df):
    out = spelling.variants(df).select("word", "n", "n_near", "form", "form_n", "root")
    return sorted(map(tuple, out.collect()), key=str)


def test_checksums_are_carried_on():
    texts = [b"", b"12:", b"x" * 40]
    sums = spelling.carried(spelling.np.array([zlib.crc32(t) for t in texts], "uint32"), 9)
    for tail in (b"", b"a", b"word\xc3\xa9xyz"):
        assert [int(x) ^ zlib.crc32(tail) for x in sums[len(tail)]] == [zlib.crc32(t + tail) for t in texts]


def test_counts_agree_with_brute_force():
    rows = odd_rows(1, 300)
    found, n = spelling.count_words([i for i, _ in rows], pa.array([t for _, t in rows]), 5)
    got = Counter()
    for w, k in zip(found.to_pylist(), n.tolist(), strict=True):
        got[w] += k
    want = brute_counts(rows)
    plain = Counter(r.translate(LOWER) for _, t in rows for r in RUN.findall(t or ""))
    assert got == want and any(want.get(w, 0) != plain[w] for w in plain if len(w) >= 5)


def test_agrees_with_brute_force(frame, monkeypatch):
    rows = odd_rows(2, 400)
    want = brute(rows)
    assert max(r[2] for r in want) > 3 and len({r[5] for r in want if r[3]}) > 5
    assert any(r[3] and r[5] != r[3] for r in want)
    assert query(frame(rows)) == want
    monkeypatch.setattr(spelling, "BATCH_BYTES", 300)
    assert query(frame(rows, partitions=9)) == want


def test_near_pairs_come_once(spark):
    rng = random.Random(3)
    pool = sorted({w for w in words(rng, 150) if len(w) >= 4} | {"aaaa", "aaaaa", "aaaaaa", "abab", "ababa", "babab"})
    df = spark.createDataFrame([(w, 1) for w in pool], "word string, n long")
    got = sorted(tuple(sorted((r["a"], r["b"]))) for r in spelling.near_pairs(df).collect())
    assert got == sorted((a, b) for a in pool for b in pool if a < b and one_edit(a, b))


def test_long_chains_end(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(61)]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {w: "w61" for w, _ in chain}


def test_odd_tables(spark, frame):
    assert query(frame([(1, "a b")]).where("false")) == []
    assert query(frame([(None, None), (2, ""), (3, "few")])) == []
    with pytest.raises(ValueError):
        spelling.variants(frame([(1, "x")]), least_letters=3)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.op13_spelling_variants(spark, sf).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
