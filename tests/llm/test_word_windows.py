from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline

WORD = re.compile(r"[^ \t-\r]+")


def brute(texts, length=51):
    """The texts without the words of any window of ``length`` words that stands twice."""
    spans = [[m.span() for m in WORD.finditer(t)] for t in texts]
    words = [[t[a:b] for a, b in s] for t, s in zip(texts, spans, strict=True)]
    found = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for t, s, w in zip(texts, spans, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if found[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept, at = [], 0
        for i, (a, b) in enumerate(s):
            if gone[i] and not (i and gone[i - 1]):
                kept.append(t[at:a])
            if gone[i]:
                at = b
        out.append("".join([*kept, t[at:]]))
    return out


def cut(spark, frame, texts):
    rows = [(k, t, "en", "a", len(t)) for k, t in enumerate(texts)]
    df = frame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.cut_repeats(spark, df, "").collect()}
    assert all(got[k]["n_chars"] == len(got[k]["text"]) for k in got)
    return [got[k]["text"] for k in range(len(texts))]


def test_a_passage_of_51_short_words_goes_and_one_of_50_long_words_stays(spark, frame):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcdefgé") for _ in range(n))
    short, long = [word(2) for _ in range(51)], [word(20) for _ in range(50)]
    own = [" ".join(word(9) for _ in range(30)) for _ in range(6)]
    texts = [f"{own[0]} {' '.join(short)} {own[1]}", f"{own[2]}\n{chr(10).join(short)}"]
    texts += [f"{own[3]} {' '.join(long)} {own[4]}", f"{' '.join(long)} {own[5]}"]
    assert cut(spark, frame, texts) == [f"{own[0]}  {own[1]}", f"{own[2]}\n", *texts[2:]]


def test_agrees_with_brute_force(spark, frame):
    rng = random.Random(2)
    base = [[rng.choice(["a", "bé", "cc", "ddd", "e" * 30]) for _ in range(200)] for _ in range(3)]
    texts = ["", " \n", "w " * 300, " ".join(base[0]), "\t".join(base[0][:51]) + " ", "x " + " ".join(base[0][100:] + base[1])]
    for _ in range(40):
        parts = [w for b in rng.choices(base, k=2) for w in b[rng.randrange(150) :][: rng.randrange(20, 90)] + [str(rng.random())]]
        texts.append(rng.choice([" ", "\n", "  "]).join(parts))
    want = brute(texts)
    assert sum(a != b for a, b in zip(texts, want, strict=True)) > 20 and any(t and "w" not in t for t in want)
    assert cut(spark, frame, texts) == want
