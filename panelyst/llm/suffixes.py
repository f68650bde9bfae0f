"""Exact removal of repeated passages by a depth-limited radix sort of suffixes.

Every byte at which a whole window of ``length`` bytes begins is a suffix, ordered by its first ``length`` bytes
only: two suffixes that agree so far are a repeat. The passes go from the most significant digit down, and a
suffix that is alone in its group leaves, as in any radix sort of this kind; what differs is how suffixes are
dealt out, so that a pass costs far less than a row for each byte:

* First digit. A window is filed under its least-hashed GRAM-byte string (the leftmost of equals). Windows that
  follow each other mostly share that string; such a run is one row, with the string's hash. Equal windows have
  equal strings at equal offsets, so a run whose string stands nowhere else holds no repeat and leaves.
* Runs that agree in all their bytes are repeats throughout. They are noted, and one of them goes on for all.
  Where a string has only one such kind of run left, nothing is left to compare.
* Second digit. The other runs are cut into cells of CELL offsets. All windows of a cell share its core, the
  bytes common to them; cells whose core is alone leave, cells that agree in all their bytes are noted.
* Last digit. Of the cells left, every window is compared in full.

A window may also be of words: a text is then the sequence of its words, each by 64 bits of hash, and all that is
said of bytes above holds for words.

Texts stay where they are; a row is known by its file and place in it (see ``places``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyst.llm import textops
from panelyst.llm.places import by_file, located, scan_with
from panelyst.sources.sinks import materialise

LENGTH = 400
GRAM = 64
CELL = 16
#: The least passage of over 50 words, and the string a window of words is filed under.
WORDS = 51
WORD_GRAM = 12
#: Windows of a text that are looked at together; bounds the memory a very long text takes.
CHUNK = 1 << 20
INVERSE = pow(textops.BASE, -1, 1 << 64)
RUNS = "gram long, whole long, file long, row long, x long, lo int, hi int"


class Powers:
    """Powers of the hash base and its inverse, as far as any text has needed."""

    def __init__(self) -> None:
        self.up, self.down = textops.powers(textops.BASE, 1 << 14), textops.powers(INVERSE, 1 << 14)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = textops.powers(textops.BASE, 2 * n), textops.powers(INVERSE, 2 * n)


def runs(data: np.ndarray, length: int, gram: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """Runs of window starts that share their least-hashed string: (its hash, the hash of all bytes of the run,
    where the string is, the first and the last window start)."""
    n, width = len(data), length - gram + 1
    powers.reach(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.up[:n], dtype=np.uint64, out=total[1:])

    def hashed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return textops.mix((total[b] - total[a]) * powers.down[a])

    m = n - gram + 1
    grams = textops.mix((total[gram:] - total[: m]) * powers.down[:m])
    key = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(m, dtype=np.uint64)
    blocks = np.full(-(-m // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    blocks[:m] = key
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    chosen = (np.minimum(back[: m - width + 1], ahead[width - 1 : m]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
    last = np.append(first[1:], len(chosen)) - 1
    x = chosen[first]
    shape = ((x - first) << 32 | (x - last)).astype(np.uint64)
    return grams[x], textops.mix(hashed(first, last + length) + textops.mix(shape)), x, first, last


def _symbols(texts: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, or the hashes of all words, one after another, and where each text begins."""
    data, offsets = textops.text_bytes(texts)
    if not words:
        return data, offsets
    hashes, _, begin = textops.words(data, offsets, fold=False)
    return hashes, begin


def _find_runs(texts: DataFrame, length: int, gram: int, words: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in textops.slices(batch, "text", CHUNK):
                data, offsets = _symbols(part.column("text"), words)
                found, places = [], []
                for i in np.flatnonzero(np.diff(offsets) >= length):
                    text = data[offsets[i] : offsets[i + 1]]
                    for at in range(0, len(text) - length + 1, CHUNK):
                        g, w, x, first, last = runs(text[at : at + CHUNK + length - 1], length, gram, powers)
                        found.append((g.view(np.int64), w.view(np.int64), x + at, x - last, x - first))
                        places.append((i, len(x)))
                if not found:
                    continue
                g, w, x, lo, hi = (np.concatenate(c) for c in zip(*found, strict=True))
                which = pa.array(np.repeat([i for i, _ in places], [k for _, k in places]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(g),
                        pa.array(w),
                        part.column("file").take(which),
                        part.column("row").take(which),
                        pa.array(x),
                        pa.array(lo.astype(np.int32)),
                        pa.array(hi.astype(np.int32)),
                    ],
                    [c.split()[0] for c in RUNS.split(", ")],
                )

    return texts.select("file", "row", "text").mapInArrow(run, RUNS)


def _contexts(texts: DataFrame, path: str, length: int, words: bool) -> DataFrame:
    """Runs with their bytes, from the first byte of their first window to the last of their last; or with the
    hashes of their words, eight bytes each."""
    unit = 8 if words else 1
    columns = ["row", "id", "gram", "x", "lo", "hi"]

    def each(part: pa.RecordBatch, side: dict, begin: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        text = part.column("text")
        for i in np.flatnonzero(end > begin):
            data = _symbols(text.slice(i, 1), words)[0].tobytes() if words else text[int(i)].as_py().encode()
            s = slice(begin[i], end[i])
            bytes_ = [data[(x - hi) * unit : (x - lo + length) * unit] for x, lo, hi in zip(side["x"][s], side["lo"][s], side["hi"][s], strict=True)]
            n = end[i] - begin[i]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(part.column("file")[int(i)].as_py(), n)),
                    *(pa.array(side[c][s]) for c in columns),
                    pa.array(bytes_, pa.binary()),
                ],
                ["file", *columns, "bytes"],
            )

    schema = "file long, row long, id long, gram long, x long, lo int, hi int, bytes binary"
    return scan_with(texts.select("file", "row", "text"), path, columns, each, schema)


def _two(*parts: Column) -> Column:
    """128 bits of hash as two longs."""
    return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"))


def _part(at: Column, n: Column, unit: int) -> Column:
    """``n`` bytes or words of a run from place ``at`` on, counted from 0."""
    return F.substring("bytes", at * unit + 1, n * unit)


def _cells(runs_: DataFrame, length: int, unit: int) -> DataFrame:
    """(id, cell, a, b, core, whole): the cells of each run; a to b are the offsets of the run that it has."""
    cell = F.explode(F.sequence(F.floor(F.col("lo") / CELL).cast("int"), F.floor(F.col("hi") / CELL).cast("int")))
    cut = runs_.withColumn("cell", cell)
    low = F.col("cell") * CELL
    a, b = F.greatest("lo", low), F.least("hi", low + (CELL - 1))
    # offset o begins at byte or word hi - o of the run
    core = _part(F.col("hi") - low, F.lit(length - CELL + 1), unit)
    whole = _part(F.col("hi") - b, b - a + length, unit)
    return cut.select(
        "id",
        "cell",
        a.alias("a"),
        b.alias("b"),
        _two(F.col("gram"), F.col("cell"), core).alias("core"),
        _two(F.col("gram"), a, b, whole).alias("whole"),
    )


def _turned(key: str, whole: bool) -> Column:
    """``key`` in other bits; a whole number, or else what ``_two`` makes."""
    return F.bitwise_not(key) if whole else F.struct(F.bitwise_not(f"{key}.h1").alias("h1"), F.col(f"{key}.h2").alias("h2"))


def _of_several(rows: DataFrame, groups: DataFrame, key: str, whole: bool = False) -> DataFrame:
    """Rows whose ``key`` stands in two or more rows of ``groups``.

    Counting deals ``groups`` out by the key. The join is on the key turned, so it deals both sides out anew: only
    then can Spark split the rows of a very common key, and the keys need not be written before.
    """
    counted = groups.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = counted.select(_turned(key, whole).alias("turned"))
    return rows.join(several, _turned(key, whole) == F.col("turned"), "left_semi")


def duplicate_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, words: bool = False) -> DataFrame:
    """(file, row, start, end) of byte ranges all of whose windows of ``length`` bytes begin elsewhere as well.
    With ``words`` all of these count words.

    ``texts`` is what ``located`` returns with a column ``text``. Ranges may overlap or repeat; together they
    cover every byte of every repeated window.
    """
    unit, gram = 8 if words else 1, min(gram, length)
    found = _find_runs(texts, length, gram, words)
    first = materialise(_of_several(found, found, "gram", whole=True), "runs")
    kinds = materialise(
        first.groupBy("gram", "whole").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "row", "x", "lo", "hi")).alias("one")
        ),
        "kinds",
    )
    start, end = F.col("x") - F.col("hi"), F.col("x") - F.col("lo") + length
    same = first.join(kinds.where("n > 1").select("gram", "whole"), ["gram", "whole"])
    spans = same.select("file", "row", start.alias("start"), end.alias("end"))

    open_runs = _of_several(kinds, kinds, "gram", whole=True).select("gram", "one.*").withColumn("id", F.monotonically_increasing_id())
    side = by_file(open_runs, "open")
    context = materialise(_contexts(texts, side, length, words), "contexts")
    places = context.select("id", "file", "row", "x")

    cells = materialise(_cells(context, length, unit), "cells")
    wholes = materialise(
        cells.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "cell", "a", "b")).alias("one")),
        "wholes",
    )
    noted = cells.join(wholes.where("n > 1").select("core", "whole"), ["core", "whole"]).select("id", "a", "b")
    open_cells = _of_several(wholes, wholes, "core").select("one.id", "one.a", "one.b")
    windows = materialise(
        open_cells.join(context, "id")
        .withColumn("a", F.explode(F.sequence("a", "b")))
        .select("id", "a", _two(F.col("gram"), F.col("a"), _part(F.col("hi") - F.col("a"), F.lit(length), unit)).alias("window")),
        "windows",
    )
    noted = noted.unionByName(_of_several(windows, windows, "window").select("id", "a", F.col("a").alias("b")))
    more = noted.join(places, "id").select(
        "file", "row", (F.col("x") - F.col("b")).alias("start"), (F.col("x") - F.col("a") + length).alias("end")
    )
    return spans.unionByName(more)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that ranges cover together."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.append(True, start[1:] > reach[:-1])
    return start[first], reach[np.append(np.flatnonzero(first)[1:] - 1, len(start) - 1)]


def _kept(data: bytes, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    edges = np.concatenate([[0], np.stack([start, end], 1).ravel(), [len(data)]])
    return [data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", scan: bool = False
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte covered by a string of ``length`` bytes that also begins at another place, in the same text or
    any other, is removed; all places are judged on the input, and strings do not cross texts. Of rows with equal
    texts of ``length`` bytes or more nothing is left. A NULL text is empty; shorter texts lose nothing; ids may
    be NULL or repeat. An empty table gives an empty result. ``scan`` is that of ``located``.
    """
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]
    texts = located(docs, columns, scan)
    spans = by_file(duplicate_spans(texts, length), "spans")

    def each(part: pa.RecordBatch, side: dict, begin: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        removed, count, digest, sizes = [], [], [], []
        for i, text in enumerate(part.column("text")):
            data = text.as_py().encode()
            a = b = np.empty(0, np.int64)
            if end[i] > begin[i]:
                a, b = merged(side["start"][begin[i] : end[i]], side["end"][begin[i] : end[i]])
            sha = hashlib.sha256()
            for piece in _kept(data, a, b):
                sha.update(piece)
            sizes.append(len(data))
            removed.append(int((b - a).sum()))
            count.append(len(a))
            digest.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(count, pa.int64()),
                pa.array(digest, pa.string()),
            ],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return scan_with(texts, spans, ["row", "start", "end"], each, schema)


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end."""
    kept = np.concatenate([[False], ~textops.SEPARATOR[data], [False]])
    return np.flatnonzero(kept[1:] & ~kept[:-1]), np.flatnonzero(kept[:-1] & ~kept[1:])


def without_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text", words: bool = False) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text_col``; all columns stay, and every row.

    A removed span that begins or ends inside a character leaves that character whole, so texts stay valid. A
    NULL text stays NULL. With ``words``, ``length`` counts words, whatever white space is between them, and spans
    go from the first byte of their first word to the last of their last.
    """
    names = docs.columns
    place = names.index(text_col)
    plain = docs.toDF(*[f"c{k}" if k != place else "text" for k in range(len(names))])
    plain = plain.withColumn("text", F.col("text").cast("string"))
    texts = located(plain, [F.col(c) for c in plain.columns], False)
    filled = texts.withColumn("text", F.coalesce("text", F.lit("")))
    spans = by_file(duplicate_spans(filled, length, WORD_GRAM if words else GRAM, words), "spans")
    kept_columns = plain.columns

    def each(part: pa.RecordBatch, side: dict, begin: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        column = part.column("text").to_pylist()
        for i in np.flatnonzero(end > begin):
            data = column[i].encode()
            a, b = merged(side["start"][begin[i] : end[i]], side["end"][begin[i] : end[i]])
            if words:
                first, last = word_edges(np.frombuffer(data, np.uint8))
                a, b = first[a], last[b - 1]
            raw = np.frombuffer(data + b"a", np.uint8)
            tail = (raw & 0xC0) == 0x80  # inside a character
            while tail[a].any():
                a = a + tail[a]
            while tail[b].any():
                b = b - tail[b]
            column[i] = b"".join(_kept(data, a, b)).decode()
        arrays = [pa.array(column, pa.string()) if c == "text" else part.column(c) for c in kept_columns]
        yield pa.RecordBatch.from_arrays(arrays, kept_columns)

    out = scan_with(texts.select(*kept_columns, "file", "row"), spans, ["row", "start", "end"], each, plain.schema)
    return out.toDF(*names)
