from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from panelyst.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    found = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if found[tuple(words[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)]


def texts():
    rng = random.Random(2)
    made = [None, "", "  ", "\n\n", "a\0b a\0b", "a\0b\nab\nab\na\0b", "é 漢 x　y", "w " * 30_000]
    return made + ["".join(rng.choice("ab \n|é") for _ in range(rng.randrange(120))) for _ in range(800)]


def test_base_counts_agree_with_brute_force():
    made = texts()
    got = quality.base_counts(quality._words(pa.array(made)))
    assert [list(map(int, r)) for r in zip(*got.values(), strict=True)] == [brute(t) for t in made]


def corpus():
    rng = random.Random(7)
    good = [f"word{k}" for k in range(60)]
    rows, labels = [], []
    for k in range(400):
        junk = k % 5 == 0
        words = [rng.choice(good) + ("%%%" if junk else "") for _ in range(rng.randrange(25, 60))]
        rows.append((k, " ".join(words)))
        if k % 2 == 0:
            labels.append((k, 0 if junk else 1))
    return rows, labels


def test_verdict(spark, frame):
    rows, labels = corpus()
    rows += [(None, None), (1000, ""), (1001, "too short"), (1002, "same eight words in a row again here " * 9), (3, rows[3][1])]
    marks = spark.createDataFrame([*labels, (None, 1), (7, None), (9, 5), (2, 1)], "doc_id long, quality int")
    out = quality.assess(frame(rows), marks).collect()
    assert len(out) == len(rows)
    kept = {r["doc_id"]: r["kept"] for r in out if r["doc_id"] is not None}
    assert sum(kept[k] != (k % 5 != 0) for k in range(400)) <= 4
    assert not kept[1000] and not kept[1001] and not kept[1002]
    failed = {r["doc_id"]: r["base_failed"] for r in out}
    assert failed[1002] and failed[None] and not failed[0]


def test_scores_are_mean_log_ratios(spark, frame):
    rows, labels = corpus()
    out = {r["doc_id"]: r["score"] for r in quality.assess(frame(rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}

    def grams(indices):
        g, of = quality.ngrams(quality._words(pa.array([rows[k][1] for k in indices])))
        return g, of

    trusted = [k for k, label in labels if label == 1]
    target = np.bincount(grams(trusted)[0], minlength=quality.BUCKETS)
    raw = np.bincount(grams(range(400))[0], minlength=quality.BUCKETS)
    ratio = np.log((target + 1) / (target.sum() + quality.BUCKETS)) - np.log((raw + 1) / (raw.sum() + quality.BUCKETS))
    for k in range(0, 400, 37):
        assert abs(out[k] - ratio[grams([k])[0]].mean()) < 1e-9


def test_without_labels_the_base_rules_decide(spark, frame):
    rows, _ = corpus()
    out = quality.assess(frame(rows), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in out)
    assert quality.assess(frame(rows).where("false"), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_best_threshold():
    assert quality.best_threshold([(-5, 0, 10), (3, 1, 20), (-2, 1, 1)]) in (-0.004, -0.002)
    assert quality.best_threshold([(1, 1, 5)]) == -quality.LIMIT
