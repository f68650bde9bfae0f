"""Language identification with string kernels.

A text is the set of its byte n-grams, n = 1 to 4 (a blended spectrum, by presence), of letters in lower case
with one blank for anything else. The kernel of two texts is the size of the common set over the geometric
mean of both. A bounded sample is seen through its kernels with LANDMARKS of its texts (Nystroem), and one
ridge regression for each language against the rest is fitted on that. Texts are scored by matrix products:
presence times landmarks, then kernels times weights.
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

BUCKETS = 1 << 14
LONGEST = 4
#: Landmarks of all languages together, and of each where languages are many.
LANDMARKS, FEWEST_LANDMARKS = 160, 2
#: Rows of each language and bytes of a text in the sample that the model is fitted on; see samples for the bound on
#: all rows, which every language shares, and for languages with longer texts only.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 32_768
#: Texts whose presence vectors are held at a time.
ROWS = 128
RIDGE = 1e-2
SHARPNESS = 4.0
UNKNOWN = "und"
LETTER = np.zeros(256, bool)
LETTER[[*range(97, 123), *range(128, 256)]] = True


class Model(NamedTuple):
    languages: list[str]
    landmarks: np.ndarray  # presence, BUCKETS x landmarks
    norms: np.ndarray
    weights: np.ndarray  # landmarks + 1 x languages


def presence(texts: pa.Array) -> np.ndarray:
    """Texts x BUCKETS: 1 where an n-gram of the text falls into the bucket."""
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    data, offsets = textops.text_bytes(lower)
    letter = LETTER[data]
    data = np.where(letter, data, np.uint8(32))
    keep = letter.copy()  # of a run of other bytes the first stays
    keep[1:] |= letter[:-1]
    keep[offsets[:-1][np.diff(offsets) > 0]] = True
    sizes = np.concatenate([[0], np.cumsum(keep)])[offsets]
    data = data[keep].astype(np.uint64)
    of = np.repeat(np.arange(len(texts)), np.diff(sizes))
    out = np.zeros((len(texts), BUCKETS), np.float32)
    key = np.zeros(len(data), np.uint64)
    for n in range(1, LONGEST + 1):
        m = max(len(data) - n + 1, 0)
        key = (key[:m] << np.uint64(8)) | data[n - 1 : n - 1 + m]
        inside = of[:m] == of[n - 1 : n - 1 + m]
        place = textops.mix(key + (np.uint64(n) << np.uint64(40))) % np.uint64(BUCKETS)
        out[of[:m][inside], place[inside].astype(np.int64)] = 1
    return out


def kernels(seen: np.ndarray, landmarks: np.ndarray, norms: np.ndarray) -> np.ndarray:
    own = np.sqrt(np.maximum(seen.sum(1), 1))
    return (seen @ landmarks) / (own[:, None] * norms[None])


def fit(texts: pa.Array, languages: list[str]) -> Model:
    """Ridge regressions of the one-versus-rest marks on Nystroem features of the texts, in their order."""
    known = sorted(set(languages))
    y = np.where(np.array(languages)[:, None] == np.array(known)[None], 1.0, -1.0)
    # landmarks: as many of each language, spread evenly over its texts
    each = max(LANDMARKS // len(known), FEWEST_LANDMARKS)
    chosen = []
    for k in range(len(known)):
        own = np.flatnonzero(y[:, k] > 0)
        chosen.extend(own[np.unique(np.linspace(0, len(own) - 1, min(each, len(own))).astype(int))])
    marks = presence(texts.take(pa.array(chosen))).T.copy()
    norms = np.sqrt(np.maximum(marks.sum(0), 1))
    parts = [kernels(presence(texts.slice(at, ROWS)), marks, norms) for at in range(0, len(texts), ROWS)]
    k_all = np.concatenate(parts).astype(np.float64)
    values, vectors = np.linalg.eigh(k_all[chosen])
    good = values > 1e-6 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    z = np.hstack([k_all @ whiten, np.ones((len(y), 1))])
    balance = 1.0 / np.maximum((y > 0).sum(0), 1)
    weight = (balance[None] * (y > 0)).sum(1)[:, None]  # every language weighs the same
    weight = weight / weight.mean()
    w = np.linalg.solve(z.T @ (weight * z) + RIDGE * len(y) * np.eye(z.shape[1]), z.T @ (weight * y))
    return Model(known, marks, norms, np.vstack([whiten @ w[:-1], w[-1:]]).astype(np.float32))


def predict(model: Model, texts: pa.Array, rows: int = ROWS) -> tuple[list[str], np.ndarray]:
    """Language and score of every text; ``und`` and 0 for a text without a letter."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
    names: list[str] = []
    scores = []
    for at in range(0, len(texts), rows):
        k = kernels(presence(texts.slice(at, rows)), model.landmarks, model.norms)
        margin = k @ model.weights[:-1] + model.weights[-1]
        share = np.exp(SHARPNESS * (margin - margin.max(1, keepdims=True)))
        names.extend(model.languages[i] for i in margin.argmax(1))
        scores.append(share.max(1) / share.sum(1))
    score = np.concatenate(scores).astype(np.float64) if scores else np.empty(0)
    names = [n if x else UNKNOWN for n, x in zip(names, lettered, strict=True)]
    return names, np.where(lettered, score, 0.0)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Held out are the rows whose crc32 of the id, as text, leaves 2 when divided by 4; the model is fitted on a
    bounded sample of the others that have a language and a text with a letter. A row without an id is not
    held out and not learnt from. A NULL text or one without a letter is ``und`` with score 0, and so is every
    text if there is nothing to learn from. Predictions look at the text only. All languages are learnt, however many
    there are. Rows that repeat are learnt once and predicted each; an empty table gives an empty result.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    ).withColumn("held_out", F.coalesce(remainder == 2, F.lit(False)))
    usable = rows.where(
        F.col("doc_id").isNotNull()
        & ~F.col("held_out")
        & F.col("lang").isNotNull()
        & F.col("text").rlike(r"\p{L}")
    )
    sample = sample_texts(usable.select("doc_id", F.col("lang").alias("stratum"), "text"), SAMPLE_ROWS, SAMPLE_BYTES, "string")
    model = None
    if len(sample):
        fitted = fit(sample.column("text").combine_chunks(), sample.column("stratum").to_pylist())
        model = docs.sparkSession.sparkContext.broadcast(tuple(fitted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, "text"):
                if model is None:
                    names, score = [UNKNOWN] * len(part), np.zeros(len(part))
                else:
                    names, score = predict(Model(*model.value), part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return rows.select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )
