"""Spelling variants: words that one edit parts, found by the chunks that an edit leaves whole.

Words are counted in numpy, batch by batch. Whether an occurrence loses a letter depends on the checksum of its
document's id and the word; the checksum of both is that of the id carried on by as many zero bytes as the word
has, combined with that of the word, so it takes one step a letter for each document and none for each occurrence.

Two words one edit apart share one of two disjoint chunks, the halves of the shorter one, at the same place or
one further in the other. The half with the edit is split in two again, which keeps what meets small: a word
gives, for each of its four quarters, a key of the quarter's number and of all letters around it, and as the longer
word of a pair the grams around the same quarters with one letter more. What joins is verified by edit distance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyst.llm import textops
from panelyst.sources.sinks import materialise

BATCH_BYTES = 1 << 21
#: A word loses a letter where this divides the checksum.
ONE_IN = 97
#: Longest word in bytes whose checksums are carried on for a batch at once.
CARRIED = 64


def _checksum_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return table


CHECKSUM = _checksum_table()
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LEAD = 0xC3  # of all of U+00C0 to U+00FF in UTF-8


def carried(checksums: np.ndarray, most: int) -> np.ndarray:
    """For each checksum and each number of zero bytes up to ``most``: the checksum's part in that of what follows."""
    out = np.empty((most + 1, len(checksums)), np.uint32)
    out[0] = checksums
    for k in range(most):
        out[k + 1] = CHECKSUM[out[k] & np.uint32(0xFF)] ^ (out[k] >> np.uint32(8))
    return out


def count_words(ids: list, texts: pa.Array, least_letters: int) -> tuple[pa.Array, np.ndarray]:
    """The words of a batch with at least ``least_letters`` letters and their occurrences, letters lost where due.

    A word may stand in the result twice, as found and as a variant of another.
    """
    data, offsets = textops.text_bytes(texts)
    data = LOWER[data]
    letter = LETTER[data]
    lead = data == LEAD
    letter |= lead
    letter[1:] |= lead[:-1]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    edge = offsets[:-1][np.diff(offsets) > 0]
    first[edge] = letter[edge]
    last[edge[1:] - 1] = letter[edge[1:] - 1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return pa.array([], pa.string()), np.empty(0, np.int64)
    hashes = textops.segment_hash(np.where(letter, data, 0).astype(np.uint64), starts)
    _, where, word, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    size = np.flatnonzero(last) + 1 - starts
    start, size = starts[where], size[where]  # of each distinct word
    letters_before = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    letters = letters_before[start + size] - letters_before[start]
    raw = data.tobytes()
    own = np.array([zlib.crc32(raw[a : a + b]) for a, b in zip(start.tolist(), size.tolist(), strict=True)], np.uint32)
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    # occurrences of words of enough letters to matter; a word too short can't grow
    at = np.flatnonzero(letters[word] >= least_letters)
    word, doc = word[at], doc[at]
    length = size[word]
    sums = carried(prefix, min(int(length.max(initial=0)), CARRIED))
    mark = sums[np.minimum(length, CARRIED), doc] ^ own[word]
    for k in np.flatnonzero(length > CARRIED):
        a = start[word[k]]
        mark[k] = zlib.crc32(raw[a : a + length[k]], int(prefix[doc[k]]))
    hit = np.flatnonzero(mark % np.uint32(ONE_IN) == 0)
    place = mark[hit].astype(np.int64) % letters[word[hit]]
    n = n - np.bincount(word[hit], minlength=len(n))
    lost, times = np.unique(np.stack([word[hit], place]), axis=1, return_counts=True)
    variants, counts = [], []
    for w, p, t in zip(*lost.tolist(), times.tolist(), strict=True):
        if letters[w] > least_letters:
            found = raw[start[w] : start[w] + size[w]].decode()
            variants.append(found[:p] + found[p + 1 :])
            counts.append(t)
    keep = np.flatnonzero((letters >= least_letters) & (n > 0))
    words = textops.strings(data, start[keep], size[keep])
    return pa.concat_arrays([words, pa.array(variants, pa.string())]), np.append(n[keep], np.array(counts, np.int64))


def word_counts(df: DataFrame, least_letters: int, id_col: str, text_col: str) -> DataFrame:
    """(word, n) of all texts; words of ``least_letters`` letters or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, "text", BATCH_BYTES):
                words, n = count_words(part.column("doc_id").to_pylist(), part.column("text"), least_letters)
                yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], ["word", "n"])

    rows = df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _quarters(m: Column) -> list[tuple[Column, Column]]:
    """Where each quarter of a word of ``m`` letters begins and ends: its halves, and the halves of those."""
    half = F.floor(m / 2)
    cuts = [F.lit(0), F.floor(half / 2), half, half + F.floor((m - half) / 2), m]
    cuts = [c.cast("int") for c in cuts]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _keys(words: DataFrame, longer: bool) -> DataFrame:
    """(key, begin, word, n): a row for each quarter; ``longer`` words stand for a partner with one letter less."""
    m = F.char_length("word") - int(longer)
    rows = []
    for k, (begin, end) in enumerate(_quarters(m)):
        before, after = F.substring("word", F.lit(1), begin), F.substring("word", end + 1 + int(longer), m)
        rows.append(F.struct(F.xxhash64(m, F.lit(k), before, after).alias("key"), begin.alias("begin")))
    made = words.select("word", "n", F.lit(longer).alias("longer"), F.explode(F.array(*rows)).alias("at"))
    return made.select("at.key", "at.begin", "word", "n", "longer")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every two words that differ by one inserted, deleted or replaced letter, once.

    ``words`` has distinct ``word`` of at least four letters and ``n``.
    """
    short = _keys(words, False).select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    other = _keys(words, False).unionByName(_keys(words, True)).withColumnsRenamed({"word": "b", "n": "n_b"})
    same = ~F.col("longer") & (F.col("a") < F.col("b"))
    # a letter put in between two quarters, or into a run of one letter, is seen in the first quarter only
    here = (F.col("begin") == 0) | (F.expr("substring(a, begin + 1)") != F.expr("substring(b, begin + 2)"))
    one_edit = F.levenshtein("a", "b", 1) == 1
    joined = short.alias("x").join(other.alias("y"), (F.col("x.key") == F.col("y.key")) & (same | F.col("longer")) & one_edit & (~F.col("longer") | here))
    return joined.select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of (word, form), by doubling the steps taken.

    A form has at least twice the occurrences of its word, so a chain has under 64 words and ends.
    """
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        stepped = materialise(stepped, "roots")
        now = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return now


def variants(df: DataFrame, least_letters: int = 5, least: int = 3, times: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    Words have ``least_letters`` letters (4 or more) and ``least`` occurrences; a form has ``times`` (2 or more) the
    occurrences of its word. A NULL or empty text has no words and a NULL id is an empty one; rows that repeat count
    each. An empty table gives no rows. Other columns are not looked at.
    """
    if least_letters < 4 or times < 2:
        raise ValueError("a word has four letters to split, and a form twice its occurrences")
    words = materialise(word_counts(df, least_letters, id_col, text_col).where(F.col("n") >= least), "words")
    pairs = near_pairs(words)
    both = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n_other")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n_other")),
    )
    # the near word of most occurrences; of several the first by code points, which is the order of UTF-8
    best = F.min(F.struct((-F.col("n_other")).alias("minus_n"), F.col("near")))
    near = pairs.select(F.explode(both).alias("at")).select("at.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    enough = -F.col("best.minus_n") >= times * F.col("n")
    found = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.minus_n")).alias("form_n"),
    )
    found = materialise(found, "forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
