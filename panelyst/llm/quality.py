"""Quality rules: base counts of whole texts and a hashed n-gram log-likelihood ratio.

Words and pairs of neighbouring words are hashed to BUCKETS numbers. Two multinomials over those are counted,
one from all trusted documents, one from the raw corpus. A document's score is the mean over its n-grams of the
log ratio of the two; a document is kept if it passes the base rules and its score reaches one threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyst.llm import textops
from panelyst.llm.places import by_file, located, scan_with
from panelyst.sources.sinks import materialise

BUCKETS = 1 << 16
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: Scores are counted in steps of this size to place the threshold.
STEP = 1e-3
LIMIT = 8.0


class Words(NamedTuple):
    data: np.ndarray
    offsets: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    begin: np.ndarray


def _words(texts: pa.Array) -> Words:
    data, offsets = textops.text_bytes(texts)
    return Words(data, offsets, *textops.words(data, offsets, fold=False))


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def base_counts(w: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n_words = np.diff(w.begin)
    in_word = ~textops.SEPARATOR[w.data]
    # lines: from a text's start or after a line feed
    first = np.zeros(len(w.data), bool)
    first[1:] = w.data[:-1] == 10
    first[w.offsets[:-1][np.diff(w.offsets) > 0]] = True
    line_at = np.flatnonzero(first)
    values = w.data.astype(np.uint64) + np.uint64(1)
    values[w.data == 10] = 0
    line = textops.segment_hash(values, line_at)
    filled = np.searchsorted(w.starts, np.append(line_at[1:], len(w.data))) > np.searchsorted(w.starts, line_at)
    of_line = np.searchsorted(w.offsets, line_at, side="right") - 1
    later = textops.repeated(line[filled], of_line[filled]) == 2
    n_dup_lines = np.bincount(of_line[filled][later], minlength=len(n_words))
    # words of 8-word windows that stand twice
    window, at = textops.windows(w.hashes, w.begin, 8)
    twice = at[textops.repeated(window, np.searchsorted(w.begin, at, side="right") - 1) > 0]
    edge = np.zeros(len(w.hashes) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 8, -1)
    return {
        "n_words": n_words,
        "word_chars": _per_text(in_word & ((w.data & 0xC0) != 0x80), w.offsets),
        "n_symbols": _per_text(SYMBOL[w.data], w.offsets),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": _per_text(np.cumsum(edge)[:-1] > 0, w.begin),
    }


def ngrams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, and the text of each."""
    pair, at = textops.windows(w.hashes, w.begin, 2)
    of_word = np.repeat(np.arange(len(w.begin) - 1), np.diff(w.begin))
    grams = np.concatenate([w.hashes, pair]) % np.uint64(BUCKETS)
    return grams.astype(np.int64), np.concatenate([of_word, of_word[at]])


def ngram_counts(texts: DataFrame, trusted: str) -> tuple[np.ndarray, np.ndarray]:
    """How often each bucket occurs in the texts of the rows that ``trusted`` lists by file, and in all texts.

    One scan, summed per batch, then by bucket.
    """

    def each(batch: pa.RecordBatch, side: dict, begin: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        marked = batch.append_column("trusted", pa.array(end > begin))
        for part in textops.slices(marked, "text"):
            grams, of = ngrams(_words(part.column("text")))
            total[1] += np.bincount(grams, minlength=BUCKETS)
            total[0] += np.bincount(grams[part.column("trusted").to_numpy(zero_copy_only=False)[of]], minlength=BUCKETS)
        met = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(met.astype(np.int32)), pa.array(total[0][met]), pa.array(total[1][met])], ["bucket", "trusted", "n"]
        )

    parts = scan_with(texts.select("file", "row", "text"), trusted, ["row"], each, "bucket int, trusted long, n long")
    out = np.zeros((2, BUCKETS), np.int64)
    sums = parts.groupBy("bucket").agg(F.sum("trusted").alias("trusted"), F.sum("n").alias("n"))
    for bucket, k, n in sums.collect():  # at most BUCKETS rows
        out[:, bucket] = k, n
    return out[0], out[1]


def log_ratio(target: np.ndarray, raw: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    def log_share(n: np.ndarray) -> np.ndarray:
        return np.log((n + smoothing) / (n.sum() + smoothing * len(n)))

    return log_share(target) - log_share(raw)


def best_threshold(rows: list[tuple[int, int, int]]) -> float:
    """The step at which most labelled documents fall on their side; (step, label, documents) in any order.

    Without documents of both labels nothing can be told apart, and every score reaches the threshold.
    """
    if len({label for _, label, _ in rows}) < 2:
        return -LIMIT
    steps = np.arange(int(-LIMIT / STEP), int(LIMIT / STEP) + 2)
    good, bad = np.zeros(len(steps)), np.zeros(len(steps))
    for step, label, n in rows:
        (good if label else bad)[step - steps[0]] += n
    lost = np.concatenate([[0], np.cumsum(good)[:-1]])
    caught = np.concatenate([[0], np.cumsum(bad)[:-1]])
    return float(steps[int(np.argmax(caught - lost))] * STEP)


def assess(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    scan: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, base_failed, score, kept.

    Trusted are the documents labelled 1 in ``labels`` (of its id and ``label_col``); the raw corpus is all of
    ``docs``. The threshold is the step of score that parts most documents labelled 1 and 0 which pass the base
    rules, over all labelled documents. A NULL or empty text has no words: score 0 and base_failed. Rows that
    repeat count each; a NULL id is assessed but never labelled; labels other than 0 and 1 are passed over, and
    an id labelled more than once takes its lowest label. ``scan`` is that of ``places.located``: texts do not
    move, only the places of trusted rows do.
    """
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    rows = located(docs, columns, scan)
    marks = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    trusted = by_file(rows.select("doc_id", "file", "row").join(marks.where("label = 1"), "doc_id").select("file", "row"), "trusted")
    model = docs.sparkSession.sparkContext.broadcast(log_ratio(*ngram_counts(rows, trusted)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, "text"):
                w = _words(part.column("text"))
                columns = base_counts(w)
                grams, of = ngrams(w)
                n = np.bincount(of, minlength=len(part))
                score = np.bincount(of, model.value[grams], len(part)) / np.maximum(n, 1)
                columns["base_failed"] = (columns["n_words"] < 20) | (100 * columns["n_repeat_words"] > 30 * columns["n_words"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(v) for v in columns.values()), pa.array(score)],
                    ["doc_id", *columns, "score"],
                )

    counts = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    scored = materialise(rows.select("doc_id", "text").mapInArrow(run, f"doc_id long, {counts}, base_failed boolean, score double"), "scored")
    step = F.floor(F.greatest(F.least(F.col("score"), F.lit(LIMIT)), F.lit(-LIMIT)) / STEP).cast("int")
    histogram = scored.where("not base_failed").join(marks, "doc_id").groupBy(step.alias("step"), "label").count()
    threshold = best_threshold([tuple(r) for r in histogram.collect()])  # at most two rows a step
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
