"""Whole texts of an Arrow batch as flat arrays: bytes, words, shingles.

All functions see complete texts. A NULL text is an empty one. Words are ``[^\\x20\\x09-\\x0D]+``; the
separators are ASCII, so words can be cut from the UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about ``most`` bytes of text; a longer text stands alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes one after another, and where each text begins (one entry more than texts)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


BASE = 0x9E3779B97F4A7C15
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A value over 0 for each byte that is no separator; FOLD gives A-Z the values of a-z.
KEEP_CASE = np.arange(1, 257, dtype=np.uint64)
KEEP_CASE[SEPARATOR] = 0
FOLD = KEEP_CASE.copy()
FOLD[65:91] += np.uint64(32)


def segment_hash(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hash of each segment of ``values``; segments begin at ``starts``, zeros do not count."""
    if not len(starts):
        return np.empty(0, np.uint64)
    length = np.diff(np.append(starts, len(values)))
    place = np.arange(starts[0], len(values), dtype=np.int64) - np.repeat(starts, length)
    weighted = values[starts[0] :] * powers(BASE, int(length.max()))[place]
    return mix(np.add.reduceat(weighted, starts - starts[0]))


def words(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every word, its first byte, and the first word of each text (one entry more than texts)."""
    gap = SEPARATOR[data]
    first = ~gap
    first[1:] &= gap[:-1]
    inner = offsets[:-1][np.diff(offsets) > 0]
    first[inner] = ~gap[inner]
    starts = np.flatnonzero(first)
    values = (FOLD if fold else KEEP_CASE)[data]
    return segment_hash(values, starts), starts, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, begin: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word windows, and where those of each text begin.

    A text with fewer words has one shingle of all its words; one without words has none.
    """
    count = np.diff(begin)
    n = len(hashes)
    window = np.zeros(max(n - size + 1, 0), np.uint64)
    for j in range(size):
        window += hashes[j : j + len(window)] * powers(BASE, size + 1)[j + 1]
    window = mix(window + np.uint64(size))
    made = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(at[-1], np.uint64)
    whole = count >= size
    place = np.repeat(begin[:-1] - at[:-1], made) + np.arange(at[-1])
    take = np.repeat(whole, made)
    out[take] = window[place[take]]
    for i in np.flatnonzero(~whole & (count > 0)):
        part = hashes[begin[i] : begin[i + 1]]
        out[at[i] : at[i] + 1] = mix((part * powers(BASE, size + 1)[1 : len(part) + 1]).sum(keepdims=True) + np.uint64(len(part)))
    return out, at


def windows(hashes: np.ndarray, begin: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the full ``size``-word windows within a text, and the first word of each."""
    n = max(len(hashes) - size + 1, 0)
    window = np.zeros(n, np.uint64)
    for j in range(size):
        window += hashes[j : j + n] * powers(BASE, size + 1)[j + 1]
    text_end = np.repeat(begin[1:], np.diff(begin))[:n]
    inside = np.flatnonzero(np.arange(n) + size <= text_end)
    return mix(window[inside]), inside


def repeated(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each key whether it stands twice or more in its text ``of``; 2 for places after its first."""
    order = np.lexsort((keys, of))
    k, o = keys[order], of[order]
    same = np.append(False, (k[1:] == k[:-1]) & (o[1:] == o[:-1]))[: len(k)]
    out = np.zeros(len(keys), np.int8)
    out[order] = np.where(same, 2, np.append(same[1:], False)[: len(k)])
    return out


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, words with A-Z in lower case."""
    data, offsets = text_bytes(texts)
    hashes, _, begin = words(data, offsets, fold=True)
    flat, at = shingles(hashes, begin, size)
    return [np.unique(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def strings(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> pa.Array:
    """The strings that begin at ``starts`` and have ``length`` bytes."""
    end = np.cumsum(length)
    total = int(end[-1]) if len(end) else 0
    flat = data[np.repeat(starts - end + length, length) + np.arange(total)]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(0, end)), pa.py_buffer(flat)).cast(pa.string())
