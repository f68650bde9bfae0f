from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from panelyst.llm import language, samples, toxicity

SYLLABLES = {"en": "th er on an re ing the".split(), "fr": "é eau oi ment ette que".split(), "de": "sch ung ei ß ver keit".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(1)
    return [(k, text(rng, lang, rng.randrange(5, 80)), lang) for k in range(600) for lang in [rng.choice(list(SYLLABLES))]]


def test_language(frame, documents):
    rows = [*documents, (None, "the thing", "en"), (2001, None, "fr"), (2002, "12 34 .", "de"), (2003, "then " * 40_000, None), documents[0]]
    out = language.identify(frame(rows, "doc_id long, text string, lang string")).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    by_id = {r["doc_id"]: r for r in out}
    held = [r for r in documents if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert [by_id[k]["held_out"] for k, _, _ in documents] == [zlib.crc32(str(k).encode()) % 4 == 2 for k, _, _ in documents]
    assert np.mean([by_id[k]["lang_pred"] == lang for k, _, lang in held]) > 0.97
    assert by_id[2001]["lang_pred"] == by_id[2002]["lang_pred"] == "und"
    assert by_id[2003]["lang_pred"] == "en" and by_id[None]["held_out"] is False


def test_language_is_told_from_the_text_alone(frame, documents):
    schema = "doc_id long, text string, lang string"
    first = {r["doc_id"]: tuple(r) for r in language.identify(frame(documents, schema)).collect()}
    held = {k for k, _, _ in documents if zlib.crc32(str(k).encode()) % 4 == 2}
    relabelled = [(k, t, "zz" if k in held else lang) for k, t, lang in documents]
    assert first == {r["doc_id"]: tuple(r) for r in language.identify(frame(relabelled, schema)).collect()}


def test_nothing_to_learn_a_language_from(frame):
    out = language.identify(frame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in out} == {"und"} and {r["score"] for r in out} == {0.0}


def test_presence_is_the_set_of_ngrams():
    seen = language.presence(pa.array(["Abc", "abc", "a1-b", "a b", None]))
    assert (seen[0] == seen[1]).all() and (seen[2] == seen[3]).all() and not seen[4].any()
    assert seen[0].sum() == 6  # a b c ab bc abc


@pytest.fixture(scope="module")
def toxic_documents():
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(900):
        lang = rng.choice(list(SYLLABLES))
        words = text(rng, lang, rng.randrange(8, 90)).split()
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                bad = rng.choice(["idiot", "moron", "scum"]) if lang == "en" else "vrok" + rng.choice(SYLLABLES[lang])
                words.insert(rng.randrange(len(words)), bad)
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_toxicity(spark, frame, toxic_documents):
    rows, labels = toxic_documents
    odd = [(None, "idiot"), (5000, None), (5001, ""), (5002, "then " * 30_000 + "idiot moron scum"), rows[0]]
    marks = spark.createDataFrame([*labels, (None, 1), (5001, None), (5002, 7)], "doc_id long, toxic int")
    out = toxicity.classify(frame([*rows, *odd]), marks).collect()
    assert len(out) == len(rows) + len(odd)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    by_id = {r["doc_id"]: r for r in out}
    truth = dict(labels)
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(by_id[k]["held_out"] for k in held) and sum(r["held_out"] for r in out) >= len(held)
    assert np.mean([by_id[k]["predicted"] == truth[k] for k in held]) > 0.95
    assert by_id[5000]["predicted"] == by_id[5001]["predicted"] == 0 and by_id[5002]["predicted"] == 1
    clean = toxicity.without_toxic(frame([*rows, *odd]), marks)
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(r["doc_id"]) for r in out if not r["predicted"])


def test_without_labels_nothing_is_toxic(spark, frame):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.classify(frame([(1, "idiot"), (2, None)]), none).collect()
    assert [r["predicted"] for r in out] == [0, 0]
    assert toxicity.classify(frame([(1, "a")]).where("false"), none).count() == 0
    assert toxicity.without_toxic(frame([(1, "idiot")]), none).count() == 1


def test_the_network_learns_a_word():
    texts = pa.array(["good words here", "bad words there", "", "good day", "bad day"] * 8)
    y = np.array([0, 1, 0, 0, 1] * 8)
    buckets, begin, _ = toxicity.words(texts)
    net = toxicity.train(buckets, begin, y)
    value = toxicity.logits(net, buckets, begin)
    assert value[y == 1].min() > value[y == 0].max()


def test_words_share_prefixes():
    buckets, begin, language_of = toxicity.words(pa.array(["abcdefgh abcdefxy", "the end of it", "der Tag und", None, "zz"]))
    assert begin.tolist() == [0, 2, 6, 9, 9, 10]
    assert buckets[1][0] == buckets[1][1] and buckets[2][0] == buckets[2][1] and buckets[0][0] != buckets[0][1]
    assert language_of.tolist() == [4, 0, 2, 4, 4]


def test_threshold_is_the_middle_of_the_gap():
    assert toxicity.threshold(np.array([0.0, 1.0, 3.0, 5.0]), np.array([0, 0, 1, 1])) == 2.0


def test_bounded_sample(spark):
    rows = [(k, "a" if k % 10 else "b", f"text {k}") for k in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, stratum string, text string")
    picked = samples.bounded_sample(samples.candidates(df, 100), 100)
    assert picked == samples.bounded_sample(samples.candidates(df.repartition(7), 100), 100)
    assert sum(s == "a" for _, s, _ in picked) == 100 and 90 <= sum(s == "b" for _, s, _ in picked) <= 100
    assert samples.bounded_sample(samples.candidates(df.where("false"), 100), 100) == []


def test_all_strata_share_the_bound_on_rows(spark):
    rows = [(k, f"s{k % 70}", "t") for k in range(7000)]
    found = samples.candidates(spark.createDataFrame(rows, "doc_id long, stratum string, text string"), 100)
    picked = samples.bounded_sample(found, 100, most_rows=700)
    assert len({s for _, s, _ in picked}) == 70 and 600 <= len(picked) <= 700


def test_one_row_of_an_id_and_long_texts_where_there_are_no_others(spark):
    rows = [(1, "a", f"text {k % 40}") for k in range(3000)] + [(k, "a", "other") for k in range(2, 12)]
    rows += [(k, "b", "x" * (200 + k)) for k in range(100, 130)]
    df = spark.createDataFrame(rows, "doc_id long, stratum string, text string").repartition(5)
    got = samples.sample_texts(df, 50, 100, "string").to_pylist()
    assert sorted(r["doc_id"] for r in got if r["stratum"] == "a") == list(range(1, 12))
    long = [r for r in got if r["stratum"] == "b"]
    assert len(long) == samples.FEWEST and 100 in {r["doc_id"] for r in long} and all(len(r["text"]) > 200 for r in long)


def test_seventy_languages_are_learnt(frame):
    rng = random.Random(7)
    tongues = {f"l{k}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(6)] for k in range(70)}
    rows = [(k, " ".join(rng.choices(tongues[f"l{k % 70}"], k=30)), f"l{k % 70}") for k in range(2100)]
    out = language.identify(frame(rows, "doc_id long, text string, lang string")).collect()
    right = [r["lang_pred"] == f"l{r['doc_id'] % 70}" for r in out if r["held_out"]]
    assert len({r["lang_pred"] for r in out}) == 70 and np.mean(right) > 0.9
    empty = language.identify(frame(rows[:3], "doc_id long, text string, lang string").where("false"))
    assert empty.count() == 0


def test_labels_of_absent_documents_and_an_id_with_most_rows(spark, frame, toxic_documents):
    rows, labels = toxic_documents
    absent = [(k, 1) for k in range(10_000, 40_000)]
    many = [(1, f"the thing {k}") for k in range(1500)]
    marks = spark.createDataFrame([*labels, *absent], "doc_id long, toxic int")
    out = {r["doc_id"]: r["predicted"] for r in toxicity.classify(frame([*rows, *many]), marks).collect()}
    truth = dict(labels)
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([out[k] == truth[k] for k in held]) > 0.95
