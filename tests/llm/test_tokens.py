from __future__ import annotations

import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from panelyst.llm import tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.load_vocabulary(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def random_texts(seed, n):
    rng = random.Random(seed)
    letters = " \n▁\tabcdethein ingosr.<>0s/éñ漢😀\x00"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(n)]


HARD = ["", " ", "a", None, "the the   the", "<s></s> <0x0A>", *("    " * k for k in range(1, 12)), "thethethe" * 5]
HARD += ["inging" * 20, "a" * 5000, "=-" * 3000, "tion" * 400, "x" * 30_000, "word " * 20_000]


def test_counts_agree_with_the_library(vocabulary, library):
    texts = HARD + random_texts(1, 800)
    got = tokens.Counter(vocabulary).count(pa.array(texts)).tolist()
    assert got == [len(x) for x in library.encode([t or "" for t in texts])]


def unbroken():
    """Texts of one pre-token: letters and digits of several kinds, and repeats that overlap themselves."""
    rng = random.Random(3)
    alphabets = ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "acgt", "etaoinshr", "ab", "0123456789abcdef"]
    out = ["".join(rng.choices(a, k=n)) for a in alphabets for n in (50, 193, 900, 20_000)]
    return out + ["the" * 3000, "ingting" * 700, "=-=" * 900, "aab" * 4000, "漢é😀" * 500]


def test_unbroken_texts_agree_with_the_library(vocabulary, library, monkeypatch):
    texts = unbroken()
    want = [len(x) for x in library.encode(texts)]
    assert tokens.Counter(vocabulary).count(pa.array(texts)).tolist() == want
    monkeypatch.setattr(tokens, "LONG", 0)  # all pre-tokens rank by rank
    texts = texts + [t or "" for t in HARD] + random_texts(4, 300)
    assert tokens.Counter(vocabulary).count(pa.array(texts)).tolist() == [len(x) for x in library.encode(texts)]


def test_a_megabyte_without_a_space(vocabulary, library):
    rng = random.Random(5)
    for alphabet in ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz"):
        text = "".join(rng.choices(alphabet, k=1_000_000))
        start = time.perf_counter()
        got = tokens.Counter(vocabulary).count(pa.array([text])).tolist()
        assert time.perf_counter() - start < 30  # seconds on a busy machine; passes over all of it took hours
        assert got == [len(library.encode(text))]


def better_pairs(seed):
    """A made vocabulary in which pairs appear that rank before the one just merged."""
    rng = random.Random(seed)
    names = sorted({"".join(rng.choices("abc", k=rng.randint(2, 5))) for _ in range(60)})
    rng.shuffle(names)
    ids = {p: i for i, p in enumerate(["a", "b", "c", *names])}
    rank = np.arange(len(ids))
    width = len(ids) + 8
    pairs = sorted((ids[p[:k]] * width + ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
    alone = np.zeros(len(ids), bool)
    for key, i in pairs:
        for part in divmod(key, width):
            alone[part] |= rank[part] >= rank[i]
    columns = (np.array(x, np.int64) for x in ([97, 98, 99], [0, 1, 2], [k for k, _ in pairs], [i for _, i in pairs]))
    return tokens.Vocabulary(*columns, rank, alone, len(ids), width, 5), {divmod(k, width): i for k, i in pairs}


@pytest.mark.parametrize("seed", range(6))
def test_better_pairs_beside_a_merge_come_first(seed):
    v, pairs = better_pairs(seed)
    rng = random.Random(seed)
    texts = ["".join(rng.choices("abc", k=rng.randint(1, 120))) for _ in range(60)]
    want = []
    for text in texts:  # one merge at a time: lowest rank, then leftmost
        s = [ord(c) - 97 for c in text]
        while found := [(pairs[p], k) for k, p in enumerate(zip(s, s[1:])) if p in pairs]:
            i, k = min(found)
            s[k : k + 2] = [i]
        want.append(len(s))
    points = np.array([ord(c) for t in texts for c in t], np.int64)
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    assert tokens.count_symbols_long(points, starts, v).tolist() == want
    assert tokens.count_symbols(points, starts, v).tolist() == want


def test_counts_do_not_depend_on_what_is_remembered(vocabulary, monkeypatch):
    texts = random_texts(2, 300)
    at_once = tokens.Counter(vocabulary).count(pa.array(texts)).tolist()
    monkeypatch.setattr(tokens, "REMEMBERED", 10)
    counter = tokens.Counter(vocabulary)
    assert [int(n) for k in range(0, 300, 7) for n in counter.count(pa.array(texts[k : k + 7]))] == at_once


def test_rows(frame, library):
    rows = [(1, "the cat"), (1, "the cat"), (None, "x"), (4, None), (5, ""), (6, "word " * 5000)]
    got = sorted(map(tuple, tokens.token_counts(frame(rows), MODEL).collect()), key=str)
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 4096) for i, t in rows]
    assert got == sorted(want, key=str)
    assert tokens.token_counts(frame(rows).where("false"), MODEL).count() == 0
