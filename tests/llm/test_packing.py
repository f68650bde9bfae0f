from __future__ import annotations

import random
import struct
import zlib
from collections import defaultdict
from itertools import product

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from panelyst.llm import packing, registry

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def source():
    with open(FILE, encoding="utf-8") as f:
        return f.read()


def random_texts(seed, n, most=200):
    rng = random.Random(seed)
    letters = " \n\t\x0b\x0c\r\x85\xa0 abcdethéñÉİßΣς漢😀é<>|'s'll0\x00²"
    marks = ["<|endoftext|>", "<|startoftext|>", "<|endoftext", "I'LL ", "<|ENDOFTEXT|>", " 12 ", "﻿", "́", " ́", "a,", ".b", "'s,", ",'s", "1.", "=", "̸", "a_b", "é,", "-é"]
    pick = lambda: rng.choice(marks) if rng.random() < 0.2 else rng.choice(letters)
    return ["".join(pick() for _ in range(rng.randint(0, most))) for _ in range(n)]


def want_ids(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def check(rows, texts, library, capacity):
    """Every id lies in one piece with its checksum, sequences are gapless, and none is padded."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, text in texts.items():
        ids, at = want_ids(library, text), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity and at & (at - 1) == 0


def test_ids_agree_with_the_library(library, source):
    texts = ["", None, " ", "a", "<|endoftext|> a <|endoftext|>b", "x" * 5000, *random_texts(3, 600)]
    texts += ["The THE the", "É É The"]
    encoder = packing.Encoder(source)
    for k in range(0, len(texts), 50):
        ids, begin = encoder.encode(pa.array(texts[k : k + 50]))
        got = [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)]
        assert got == [want_ids(library, t)[:-1] for t in texts[k : k + 50]]


def test_closest_multiset_against_all_multisets():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 12): rng.randint(1, 3) for _ in range(rng.randint(0, 4))}
        room = rng.randint(1, 30)
        sums = [sum(s * k for s, k in zip(counts, ks, strict=True)) for ks in product(*[range(n + 1) for n in counts.values()])]
        best, taken = packing.closest(counts, room)
        assert best == max(s for s in sums if s <= room)
        assert sum(s * k for s, k in taken.items()) == best and all(k <= counts[s] for s, k in taken.items())


@pytest.mark.parametrize("counts", [{}, {1: 3}, {16: 4}, {11: 1000}, {11: 1000, 5: 300, 3: 7}, {s: s for s in range(1, 17)}, dict.fromkeys(range(1, 17), 20), {7: 1}])
def test_plan_places_every_piece_once(counts):
    import numpy as np

    plan = packing.plan_windows(counts, 16)
    length = np.repeat(np.array(list(counts), np.int64), list(counts.values()))
    rank = np.concatenate([np.arange(n) for n in counts.values()] or [np.empty(0, np.int64)])
    piece, part, shift, size, sequence, offset = packing.place_pieces(plan, length, rank, 16)
    assert np.bincount(piece, size, len(length)).tolist() == length.tolist()
    cells = {(s, o + k) for s, o, n in zip(sequence.tolist(), offset.tolist(), size.tolist(), strict=True) for k in range(n)}
    assert len(cells) == length.sum() and all(o < 16 for _, o in cells)
    filled = defaultdict(int)
    for s, _ in cells:
        filled[s] += 1
    assert all(n & (n - 1) == 0 and (s, k) in cells for s, n in filled.items() for k in range(n))
    if counts == dict.fromkeys(range(1, 17), 20):
        assert (part < 0).all()


def test_odd_rows(spark, frame, library, source):
    rng = random.Random(6)
    texts = {k: t for k, t in enumerate(["", None, "  ", "word " * 9000, "same text here " * 20, "z" * 3000, *random_texts(7, 60, 900)])}
    texts |= {k: "a hot copy of a text that is common " * 9 for k in range(100, 160)}
    rows = [(k, t) for k, t in texts.items()]
    rng.shuffle(rows)
    check(packing.pack(frame(rows, partitions=5), source, 256).collect(), texts, library, 256)
    assert packing.pack(frame(rows).where("false"), source).count() == 0
    again = packing.pack(frame([(None, "x y"), (None, "x y"), (3, None)]), source).collect()
    assert sum(r["length"] for r in again if r["doc_id"] is None) == 6
    with pytest.raises(ValueError):
        packing.pack(frame(rows), source, 100)


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = registry.op11_packing(spark, sf).collect()
    check(rows, texts, library, 4096)
    assert rows[0].asDict().keys() == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
