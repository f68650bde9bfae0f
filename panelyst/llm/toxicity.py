"""Toxicity: a convolutional text classifier in numpy.

A word (letters in lower case) is the sum of three hashed embeddings: of the whole word and of its first four
and six bytes, so that inflected forms share what was learnt. Filters one, two and three words wide run over
the whole text, each keeps its highest value, and a logistic layer reads those. The first coordinate of an
embedding starts at the log odds of its bucket in the training texts; all else starts at random and everything
is trained by Adagrad. On a fifth of the sample, kept out of the training, a threshold is set for each
language (told from function words of the text); scores are shifted so that it lies at 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyst.llm import textops
from panelyst.llm.samples import sample_texts

BUCKETS = 1 << 15
PREFIXES = (0, 4, 6)  # bytes; 0 is the whole word
WIDTH = 16
FILTERS = 12
SPANS = (1, 2, 3)
#: Labelled rows of each class, and bytes of a text in the sample that the model is fitted on; see samples.
SAMPLE_ROWS, SAMPLE_BYTES = 1200, 32_768
UPDATES, FEWEST_EPOCHS, MOST_EPOCHS, BATCH = 500, 4, 30, 32
#: Calibration texts of each class that a language needs for a threshold of its own.
CALIBRATION_TEXTS = 8
#: Bytes of text and words that are worked on together; a longer text stands alone.
SLICE, WORDS = 1 << 20, 1 << 17
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Function words that tell languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was",
    "fr": "le la les de des et un une que dans",
    "de": "der die das und ist nicht ein mit den von",
    "es": "el la los que y en de las por con",
}


class Net(NamedTuple):
    embed: np.ndarray  # len(PREFIXES) x BUCKETS x WIDTH
    filters: np.ndarray  # sum(SPANS) x WIDTH x FILTERS
    bias: np.ndarray  # len(SPANS) x FILTERS
    out: np.ndarray  # len(SPANS) * FILTERS
    intercept: np.ndarray  # 1


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    hashes, marks = [], []
    for k, words in enumerate(FUNCTION_WORDS.values()):
        for word in words.split():
            values = np.frombuffer(word.encode(), np.uint8).astype(np.uint64) + np.uint64(1)
            hashes.append(textops.segment_hash(values, np.array([0]))[0])
            marks.append(k)
    return np.array(hashes, np.uint64), np.array(marks)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (prefix x word) of all words, the first word of each text, and the language of each text.

    The language is an index into FUNCTION_WORDS, one beyond it for texts without any of those.
    """
    data, offsets = textops.text_bytes(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")))
    letter = LETTER[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    inner = offsets[:-1][np.diff(offsets) > 0]
    first[inner] = letter[inner]
    starts = np.flatnonzero(first)
    begin = np.searchsorted(starts, offsets)
    values = np.where(letter, data.astype(np.uint64) + np.uint64(1), np.uint64(0))
    hashes = [textops.segment_hash(values, starts)]
    if len(starts):
        place = np.arange(len(data)) - np.repeat(np.append(0, starts), np.diff(np.concatenate([[0], starts, [len(data)]])))
        hashes += [textops.segment_hash(np.where(place < n, values, 0), starts) for n in PREFIXES[1:]]
    else:
        hashes += [hashes[0]] * (len(PREFIXES) - 1)
    buckets = np.stack([(h % np.uint64(BUCKETS)).astype(np.int32) for h in hashes])
    table, marks = _language_table()
    counts = np.zeros((len(texts), len(FUNCTION_WORDS) + 1))
    counts[:, -1] = 0.5
    of = np.repeat(np.arange(len(texts)), np.diff(begin))
    hit = np.flatnonzero(np.isin(hashes[0], table))
    for h, k in zip(table, marks, strict=True):
        counts[:, k] += np.bincount(of[hit][hashes[0][hit] == h], minlength=len(texts))
    return buckets, begin, counts.argmax(1)


def _conv(net: Net, x: np.ndarray) -> list[np.ndarray]:
    """Filter values at every word of ``x``, whose last rows are blanks; one array for each span."""
    n = len(x) - max(SPANS) + 1
    taps = x @ net.filters.transpose(1, 0, 2).reshape(WIDTH, -1)
    out, k = [], 0
    for s, span in enumerate(SPANS):
        h = net.bias[s] + taps[:n, k * FILTERS : (k + 1) * FILTERS]
        for j in range(1, span):
            h = h + taps[j : j + n, (k + j) * FILTERS : (k + j + 1) * FILTERS]
        out.append(h)
        k += span
    return out


def _spread(buckets: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with blanks after each text: buckets, a mark for real words, and the new first places."""
    gap = max(SPANS) - 1
    n = np.diff(begin)
    at = begin[:-1] + gap * np.arange(len(n))
    place = np.arange(buckets.shape[1]) + gap * np.repeat(np.arange(len(n)), n)
    total = buckets.shape[1] + gap * (len(n) + 1)
    wide = np.zeros((len(PREFIXES), total), np.int32)
    wide[:, place] = buckets
    real = np.zeros(total, np.float32)
    real[place] = 1
    return wide, real, at


def _embed(net: Net, wide: np.ndarray, real: np.ndarray) -> np.ndarray:
    x = net.embed[0][wide[0]]
    for k in range(1, len(PREFIXES)):
        x += net.embed[k][wide[k]]
    return x * real[:, None]


def pooled(net: Net, buckets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The highest value of every filter in each text, 0 at least."""
    n = np.diff(begin)
    out = np.zeros((len(n), len(SPANS) * FILTERS), np.float32)
    if not buckets.shape[1]:
        return out
    wide, real, _ = _spread(buckets, begin)
    is_word = real[: len(real) - max(SPANS) + 1] > 0
    full = n > 0
    for s, h in enumerate(_conv(net, _embed(net, wide, real))):
        top = np.maximum.reduceat(h[is_word], begin[:-1][full])
        out[full, s * FILTERS : (s + 1) * FILTERS] = np.maximum(top, 0)
    return out


def logits(net: Net, buckets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The logistic layer's input for each text, some WORDS at a time."""
    out = np.zeros(len(begin) - 1)
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(begin, begin[at] + WORDS, side="right")) - 1)
        part = buckets[:, begin[at] : begin[to]]
        out[at:to] = pooled(net, part, begin[at : to + 1] - begin[at]) @ net.out + net.intercept[0]
        at = to
    return out


def _log_odds(buckets: np.ndarray, begin: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each prefix and bucket the log odds of label 1 by texts it occurs in; 0 for one never met."""
    of = np.repeat(np.arange(len(y)), np.diff(begin))
    out = np.zeros((len(PREFIXES), BUCKETS))
    n1, n0 = y.sum(), (1 - y).sum()
    for k in range(len(PREFIXES)):
        seen = np.unique(of.astype(np.int64) * BUCKETS + buckets[k])
        mark, bucket = y[seen // BUCKETS], seen % BUCKETS
        d1, d0 = np.bincount(bucket, mark, BUCKETS), np.bincount(bucket, 1 - mark, BUCKETS)
        share = np.log((d1 + 2) / (n1 + 4)) - np.log((d0 + 2) / (n0 + 4))
        out[k] = np.clip(share - (np.log(2 / (n1 + 4)) - np.log(2 / (n0 + 4))), -4, 6)
    return out


def train(buckets: np.ndarray, begin: np.ndarray, y: np.ndarray, seed: int = 10) -> Net:
    """Fit the network on texts with marks ``y`` (0 or 1), each class weighing the same."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (len(PREFIXES), BUCKETS, WIDTH)).astype(np.float32)
    embed[:, :, 0] = _log_odds(buckets, begin, y) / 4
    filters = rng.normal(0, 0.3, (sum(SPANS), WIDTH, FILTERS)).astype(np.float32)
    filters[:, 0, : FILTERS // 2] = np.abs(filters[:, 0, : FILTERS // 2]) + 0.3
    net = Net(
        embed,
        filters,
        np.zeros((len(SPANS), FILTERS), np.float32),
        rng.normal(0, 0.1, len(SPANS) * FILTERS).astype(np.float32),
        np.zeros(1, np.float32),
    )
    sums = [np.full(p.shape, 1e-2, np.float32) for p in net]
    rate = 0.05
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    batches = max(len(y) // BATCH, 1)
    for _ in range(int(np.clip(UPDATES // batches, FEWEST_EPOCHS, MOST_EPOCHS))):
        for rows in np.array_split(rng.permutation(len(y)), batches):
            rows = rows[np.diff(begin)[rows] > 0]  # a text without words moves the intercept only; left out
            if not len(rows):
                continue
            part = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in rows])
            at = np.concatenate([[0], np.cumsum(np.diff(begin)[rows])])
            wide, real, place = _spread(buckets[:, part], at)
            x = _embed(net, wide, real)
            hs = _conv(net, x)
            n = np.diff(at)
            top = np.zeros((len(SPANS), len(rows), FILTERS), np.int64)
            for s, h in enumerate(hs):
                for i in range(len(rows)):
                    top[s, i] = place[i] + h[place[i] : place[i] + n[i]].argmax(0)
            columns = np.arange(FILTERS)
            value = np.stack([np.maximum(h[top[s], columns], 0) for s, h in enumerate(hs)])
            flat = value.transpose(1, 0, 2).reshape(len(rows), -1)
            p = 1 / (1 + np.exp(-np.clip(flat @ net.out + net.intercept[0], -30, 30)))
            error = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            g_out = flat.T @ error + 1e-4 * net.out
            g_value = (error[:, None] * net.out[None]).reshape(len(rows), len(SPANS), FILTERS).transpose(1, 0, 2) * (value > 0)
            g_filters = np.zeros_like(net.filters)
            touched, g_touched, k = [], [], 0
            for s, span in enumerate(SPANS):
                for j in range(span):
                    g_filters[k + j] = np.einsum("bf,bfd->df", g_value[s], x[top[s] + j])
                    touched.append((top[s] + j).ravel())
                    g_touched.append((g_value[s][:, :, None] * net.filters[k + j].T[None]).reshape(-1, WIDTH))
                k += span
            spots = np.concatenate(touched)
            g_x = np.concatenate(g_touched) * real[spots][:, None]
            steps = (g_filters, g_value.sum(1), g_out, error.sum(keepdims=True))
            for q in range(len(PREFIXES)):
                ids, inverse = np.unique(wide[q][spots], return_inverse=True)
                g = np.zeros((len(ids), WIDTH), np.float32)
                np.add.at(g, inverse, g_x)
                sums[0][q][ids] += g * g
                net.embed[q][ids] -= rate * g / np.sqrt(sums[0][q][ids])
            for param, total, g in zip(net[1:], sums[1:], steps, strict=True):
                total += g * g
                param -= rate * g / np.sqrt(total)
    return net


def threshold(values: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest range of cuts that leave most texts on their side."""
    order = np.argsort(values, kind="stable")
    v, mark = values[order], y[order]
    right = np.concatenate([[0], np.cumsum(1 - mark)]) + mark.sum() - np.concatenate([[0], np.cumsum(mark)])
    edge = np.concatenate([[v[0] - 2], v, [v[-1] + 2]])
    widths = np.where(right == right.max(), np.diff(edge), -1)
    best = int(widths.argmax())
    return float((edge[best] + edge[best + 1]) / 2)


def _all_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``words`` of many texts, slice by slice."""
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    parts = [words(part.column("text")) for part in textops.slices(batch, "text", SLICE)]
    n = np.concatenate([np.diff(begin) for _, begin, _ in parts])
    return np.concatenate([b for b, _, _ in parts], axis=1), np.concatenate([[0], np.cumsum(n)]), np.concatenate([k for _, _, k in parts])


def fit(texts: pa.Array, y: np.ndarray) -> tuple[Net, np.ndarray]:
    """The network and the threshold of each language, from texts and their marks."""
    buckets, begin, language = _all_words(texts)
    kept_out = np.zeros(len(y), bool)
    for mark in (0, 1):
        own = np.flatnonzero(y == mark)
        kept_out[own[::5]] = len(own) >= 10
    use = np.flatnonzero(~kept_out)
    part = np.concatenate([np.arange(begin[i], begin[i + 1]) for i in use])
    net = train(buckets[:, part], np.concatenate([[0], np.cumsum(np.diff(begin)[use])]), y[use])
    value = logits(net, buckets, begin)
    judge = kept_out if {0, 1} <= set(y[kept_out].tolist()) else np.ones(len(y), bool)
    cuts = np.full(len(FUNCTION_WORDS) + 1, threshold(value[judge], y[judge]))
    for k in range(len(cuts)):
        own = judge & (language == k)
        if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= CALIBRATION_TEXTS:
            cuts[k] = threshold(value[own], y[own])
    return net, cuts


def score(net: Net, cuts: np.ndarray, texts: pa.Array) -> np.ndarray:
    buckets, begin, language = words(texts)
    return 1 / (1 + np.exp(-np.clip(logits(net, buckets, begin) - cuts[language], -30, 30)))


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """(network, thresholds) from the labelled rows that are not held out, or None without both classes."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    marks = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("stratum"))
        .where(F.col("doc_id").isNotNull() & F.col("stratum").isin(0, 1) & (remainder != 0))
        .groupBy("doc_id")
        .agg(F.max("stratum").alias("stratum"))
    )
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where("doc_id is not null and text is not null")
    sample = sample_texts(rows, SAMPLE_ROWS, SAMPLE_BYTES, "int", marks)
    y = np.array(sample.column("stratum").to_pylist(), np.int64)
    return fit(sample.column("text").combine_chunks(), y) if {0, 1} <= set(y.tolist()) else None


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Held out are the rows whose crc32 of the id, as text, divides by 5; the model is fitted on a bounded sample
    of the other labelled rows. Scores look at the text only: a NULL or empty text is scored as one without
    words. A row without an id is not held out. An id labelled twice counts as toxic if one label says so;
    labels other than 0 and 1 are passed over. Without labels of both classes every score is 0.
    """
    fitted = fit_on(docs, labels, id_col, text_col, label_col)
    model = None if fitted is None else docs.sparkSession.sparkContext.broadcast((tuple(fitted[0]), fitted[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, "text", SLICE):
                value = np.zeros(len(part))
                if model is not None:
                    value = score(Net(*model.value[0]), model.value[1], part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(value), pa.array((value >= 0.5).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marked = rows.withColumn("held_out", F.coalesce(remainder == 0, F.lit(False)))
    return marked.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of ``docs`` that ``classify`` predicts 0 for, with all their columns; no shuffle."""
    fitted = fit_on(docs, labels, id_col, text_col, label_col)
    if fitted is None:
        return docs
    model = docs.sparkSession.sparkContext.broadcast((tuple(fitted[0]), fitted[1]))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, text_col, SLICE):
                value = score(Net(*model.value[0]), model.value[1], part.column(place))
                yield part.filter(pa.array(value < 0.5))

    return docs.mapInArrow(run, docs.schema)
