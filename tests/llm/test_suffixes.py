from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from panelyst.llm import suffixes


def brute(texts, length):
    found = Counter()
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - length + 1):
            found[b[i : i + length]] += 1
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if found[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(b)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("ab é") for _ in range(700)) for _ in range(3)]
    made = [None, "", "a" * 3000, "ab" * 500, base[0], base[0][:450], base[0][100:] + base[1], "x" + base[1][50:600] + "y" * 399]
    made += [base[2], base[2], base[2][:399], "z" * 400]
    for _ in range(25):
        made.append(rng.choice(base)[rng.randrange(300) :][: rng.randrange(700)] + rng.choice(base)[:500])
    return made


@pytest.mark.parametrize("length", [400, 90])
def test_agrees_with_brute_force(frame, length):
    made = texts(3)
    rows = [(k if k % 7 else None, t) for k, t in enumerate(made)]
    got = suffixes.remove_repeats(frame(rows), length)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = [(k if k % 7 else None, *b) for k, b in enumerate(brute(made, length))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_long_texts_are_looked_at_in_chunks(frame, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 500)
    made = texts(4) + ["".join(random.Random(9).choice("abcd") for _ in range(5000)) * 2]
    got = suffixes.remove_repeats(frame(list(enumerate(made))))
    want = [(k, *b) for k, b in enumerate(brute(made, 400))]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_many_copies_of_one_passage(frame):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(600))
    made = ["".join(rng.choice("ijkl ") for _ in range(rng.randrange(50, 300))) + passage + str(k) for k in range(120)]
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(frame(list(enumerate(made)))).collect()}
    assert all(600 <= got[k]["n_removed"] <= 610 and got[k]["n_spans"] == 1 for k in range(120))


def test_texts_without_repeats_stay_valid(frame):
    made = texts(6)
    df = frame(list(enumerate(made)))
    out = suffixes.without_repeats(df)
    assert out.columns == df.columns and out.schema.simpleString() == df.schema.simpleString()
    cut = {r["doc_id"]: r["text"] for r in out.collect()}
    for k, (n, removed, _, digest) in enumerate(brute(made, 400)):
        if made[k] is None:
            assert cut[k] is None
        else:
            kept = cut[k].encode()
            assert 0 <= len(kept) - (n - removed) <= 4 * 20
            if made[k].isascii():
                assert hashlib.sha256(kept).hexdigest() == digest


def test_empty_table(frame):
    empty = frame([(1, "x")]).where("false")
    assert suffixes.remove_repeats(empty).count() == 0
    assert suffixes.without_repeats(empty).count() == 0


def test_merged():
    a, b = suffixes.merged(np.array([5, 0, 10, 30]), np.array([12, 3, 20, 31]))
    assert a.tolist() == [0, 5, 30] and b.tolist() == [3, 20, 31]
