from __future__ import annotations

from collections import defaultdict

import pytest

import corpus_pipeline
from test_minhash import brute, shingle_set
from test_word_windows import brute as brute_cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("steps")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_all_but_the_last_return_the_columns_of_documents(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "suffix_dedup", "decontamination", "mixing"]
    assert all(df.columns == steps[0].columns for df in steps[:-1])
    assert steps[-1].columns == [*steps[0].columns, "copies"]


def test_toxic_documents_go_and_others_stay(spark, steps):
    from panelyst.llm import toxicity

    said = {r["doc_id"]: r["predicted"] for r in toxicity.classify(steps[0], spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert set(rows(steps[1])) == {k for k, p in said.items() if not p}


def test_one_of_each_group_stays(steps):
    before = [(k, r["text"]) for k, r in sorted(rows(steps[1]).items())]
    assert set(rows(steps[2])) == {k for k, _, head, kept in brute(before) if kept}


def test_repeats_are_cut(steps):
    before = sorted(rows(steps[2]).items())
    after = rows(steps[3])
    assert set(after) == {k for k, _ in before}
    want = brute_cut([r["text"] for _, r in before])
    assert [after[k]["text"] for k, _ in before] == want
    assert any(r["text"] != text for (_, r), text in zip(before, want, strict=True))
    assert all(after[k]["n_chars"] == len(after[k]["text"]) for k in after)


def test_leaks_go(spark, steps):
    items = [shingle_set(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    keep = set()
    for k, r in rows(steps[3]).items():
        own = shingle_set(r["text"])
        if not any(b and 100 * len(own & b) >= 75 * len(b) for b in items):
            keep.add(k)
    assert set(rows(steps[4])) == keep


def test_the_mix_keeps_rows_as_they_are(steps):
    before, after = rows(steps[4]), rows(steps[5])
    assert after and all(tuple(after[k])[:-1] == tuple(before[k]) and 1 <= after[k]["copies"] <= 3 for k in after)
    words = defaultdict(int)
    for r in after.values():
        words[r["source"]] += r["copies"] * len(r["text"].split())
    assert sum(words.values()) > 0.7 * sum(len(r["text"].split()) for r in before.values())


def test_run(spark, steps):
    got = {r["doc_id"]: r["copies"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {k: r["copies"] for k, r in rows(steps[5]).items()}
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_rows(spark, frame):
    """NULLs in every column, repeated rows, empty texts, and columns the stages use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "w " * 3000, None, None, 5)]
    odd += [(None, "the only one of its kind here", "en", "b", 1)] * 2
    for _, stage in corpus_pipeline.STAGES:
        df = frame(odd, schema)
        out = stage(spark, df, SF)
        assert out.columns[: len(df.columns)] == df.columns and out.count() <= len(odd)
        assert stage(spark, df.where("false"), SF).count() == 0


def test_stages_take_columns_of_their_own_names(spark, frame):
    """Columns named as those that stages use inside stay, and rows that differ in one of them alone are told apart."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies int, leak_id long, kept_id long, tie long, sid long"
    text = "some words of a text that stands here but once and for all"
    odd = [(1, text, "en", "a", 1, 5, 6, 7, 8, 9), (1, text, "de", "a", 1, 5, 6, 7, 8, 9), (2, None, None, None, None, None, None, None, None, None)]
    odd += [(3, "another text of some words that has nothing in common with it", "en", "b", 2, 1, 1, 1, 1, k) for k in (0, 0, 1)]
    df = frame(odd, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        assert sorted(out.columns) == sorted(df.columns), name
        got = [tuple(r) for r in out.select("doc_id", "lang", "leak_id", "kept_id", "tie", "sid").collect()]
        assert set(got) <= {(r[0], r[2], *r[6:10]) for r in odd}, name
    mixed = corpus_pipeline.mix_sources(spark, df, SF).select("doc_id", "lang", "sid", "copies").collect()
    assert len({tuple(r)[:3] for r in mixed}) == len(mixed) and sum(r["copies"] for r in mixed) >= 4
