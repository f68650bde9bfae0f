from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from panelyst.llm import divergence, textops

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, least=10, top=10):
    """(lang, source, text) rows to the whole result, in Python integers."""
    docs = [((lang or ""), (source or ""), terms_of(text)) for lang, source, text in rows]
    df, count, all_count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in docs:
        groups[lang].add(source)
        df[lang].update(set(words))
        count[lang, source].update(words)
        all_count[lang].update(words)
    out = []
    ranked = lambda pairs: sorted(pairs, key=lambda x: (-x[1], x[0].encode()))
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]

        def shares(counter, kept=kept):
            under = sum(counter[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counter[t] + 2) // under for t in kept}

        q, p = shares(all_count[lang]), {s: shares(count[lang, s]) for s in sources}
        far = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(o, sum(far(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            marks = [(t, far(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", t, v, k + 1) for k, (t, v) in enumerate(ranked(pairs))]
            out += [(lang, s, "term", t, v, k + 1) for k, (t, v) in enumerate(ranked(marks)[:top])]
    return sorted(out)


def odd_rows(seed, n):
    rng = random.Random(seed)
    long = ["ü" * 9, "a" * 16, "a" * 17, "b" * 17, "é" * 8 + "x", "c" * 300, "漢" * 40, "a" * 8, "a" * 9, "abcdefgh", "abcdefghi"]
    words = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 3))) for _ in range(60)] + long
    out = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", ".", "\n", "0", "_", "@", "\x00", "", "{"]) for _ in range(rng.randint(0, 60)))
        out.append((rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "b", "ü", None, "z"]), rng.choice([text, text.upper(), text.title()])))
    return [*out, ("fr", "a", ""), ("fr", "b", None), ("fr", "b", "few words"), ("one", "x", "alone " * 3), ("en", "silent", "1 2 3")]


def audit(spark, rows, partitions=4, **more):
    wide = [(7, *r, "x", 5, 6) for r in rows]
    df = spark.createDataFrame(wide, "doc_id long, lang string, source string, text string, term string, n long, place long")
    got = divergence.audit(df.repartition(partitions), **more)
    return sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect()))


def test_counts_by_length_agree_with_a_counter():
    texts = [t for _, _, t in odd_rows(1, 80)] + ["", "x", "a" * 100_000, "B" * 8 + "é"]
    data, offsets = textops.text_bytes(pa.array(texts))
    group = np.arange(len(texts)) // 7
    data = divergence.LOWER[data]
    want, docs = Counter(), Counter()
    for k, t in enumerate(texts):
        want.update((w, k // 7) for w in terms_of(t))
        docs.update((w, k // 7) for w in set(terms_of(t)))
    got = {}
    for start, length, g, n, df in zip(*divergence.count_terms(data, offsets, group), strict=True):
        key = (data[start : start + length].tobytes().decode(), int(g))
        assert key not in got
        got[key] = (n, df)
    assert got == {k: (want[k], docs[k]) for k in want}


def test_radix_order_is_stable():
    rng = np.random.default_rng(2)
    low, high = rng.integers(0, 3, 500).astype(np.uint64) << np.uint64(40), rng.integers(0, 3, 500).astype(np.uint64)
    assert divergence.radix_order([low, high]).tolist() == np.lexsort((low, high)).tolist()


def test_agrees_with_brute_force(spark, monkeypatch):
    rows = odd_rows(3, 400)
    want = brute(rows)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[0] == "fr" and r[4] == 0 for r in want)
    assert audit(spark, rows) == want
    monkeypatch.setattr(divergence, "BLOCK", 2)  # several blocks and buckets give the same sums
    monkeypatch.setattr(divergence, "BUCKET", 40)
    monkeypatch.setattr(divergence, "BATCH_BYTES", 200)
    assert audit(spark, rows, 7) == want


def test_odd_tables(spark):
    assert audit(spark, odd_rows(3, 1)[:0]) == []
    rows = [(None, None, None)] * 3
    assert audit(spark, rows) == brute(rows) == []
    rows = [("en", "a", "tie tie other")] * 12 + [("en", "b", "other")] * 11
    assert audit(spark, rows) == brute(rows)
    assert audit(spark, rows, least_documents=1, top=1) == brute(rows, 1, 1)
