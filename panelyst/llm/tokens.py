"""Token counts of whole texts by rank-synchronous array merging.

A batch of texts is cut into pre-tokens (a run of spaces with what follows it, up to the next space). All
pre-tokens not met before stand in one ragged array of symbols. In every pass each pre-token's pair of lowest
rank is merged at all its places at once; a pre-token without a mergeable pair leaves with its symbols counted.
A pass over a very long pre-token would look at all of it for the few places of one rank. Long ones therefore
keep the places of every rank at hand and go through the ranks from the lowest up, looking at these places only.

The vocabulary comes from a sentencepiece model; the library that encodes is used in tests only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyst.llm import textops

SPACE = "▁"
NO_RANK = np.int64(1) << 40
#: Pre-tokens whose counts a task remembers at a time.
REMEMBERED = 1 << 20
#: Characters from which a pre-token is merged rank by rank instead of pass by pass; the counts are the same.
LONG = 192


class Vocabulary(NamedTuple):
    """Pieces by rank. Symbols above the pieces are unknown characters: ``unknown + k`` counts k bytes."""

    characters: np.ndarray  # code points of one-character pieces, sorted
    character_ids: np.ndarray
    pairs: np.ndarray  # left * width + right, sorted
    merged: np.ndarray  # the piece a pair makes
    rank: np.ndarray  # of each piece; lower merges first
    alone: np.ndarray  # of each rank: merge one place a pass, since a better pair may appear beside it
    unknown: int
    width: int
    longest: int  # characters of the longest piece


def load_vocabulary(model_file: str) -> Vocabulary:
    """Ranks, characters and mergeable pairs of a BPE model with byte fallback and no text normalisation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = model.get_piece_size()
    ordinary = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    ids = {model.id_to_piece(i): i for i in ordinary}
    if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in ids):
        raise ValueError("a piece with a space inside or a line break cannot be cut into pre-tokens")
    scores = {i: model.get_score(i) for i in ordinary}
    rank = np.full(n, NO_RANK)
    order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
    for i in ordinary:
        rank[i] = order[scores[i]]
    width = n + 8
    found = []
    alone = np.zeros(n, bool)
    for piece, i in ids.items():
        for k in range(1, len(piece)):
            left, right = ids.get(piece[:k]), ids.get(piece[k:])
            if left is not None and right is not None:
                found.append((left * width + right, i))
                for part in (left, right):
                    if rank[part] >= rank[i]:
                        alone[part] = True
    found.sort()
    single = sorted((ord(p), i) for p, i in ids.items() if len(p) == 1)
    return Vocabulary(
        np.array([c for c, _ in single], np.int64),
        np.array([i for _, i in single], np.int64),
        np.array([k for k, _ in found], np.int64),
        np.array([i for _, i in found], np.int64),
        rank,
        alone,
        n,
        width,
        max(map(len, ids), default=1),
    )


def _symbols(points: np.ndarray, v: Vocabulary) -> np.ndarray:
    at = np.minimum(np.searchsorted(v.characters, points), len(v.characters) - 1)
    n_bytes = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    return np.where(v.characters[at] == points, v.character_ids[at], v.unknown + n_bytes)


def count_symbols(points: np.ndarray, starts: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Tokens of each pre-token; pre-tokens are consecutive runs of code points beginning at ``starts``."""
    n = len(starts)
    out = np.zeros(n, np.int64)
    sym = _symbols(points, v)
    seq = np.repeat(np.arange(n), np.diff(np.append(starts, len(points))))
    while len(sym):
        key = sym[:-1] * v.width + sym[1:]
        at = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
        piece = np.where((v.pairs[at] == key) & (seq[1:] == seq[:-1]), v.merged[at], -1)
        rank = np.append(np.where(piece >= 0, v.rank[piece], NO_RANK), NO_RANK)
        head = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
        best = np.minimum.reduceat(rank, head)
        length = np.diff(np.append(head, len(sym)))
        done = np.repeat(best == NO_RANK, length)
        if done.any():
            weight = np.where(sym[done] > v.unknown, sym[done] - v.unknown, 1)
            out += np.bincount(seq[done], weight, n).astype(np.int64)
            if done.all():
                break
        hit = np.flatnonzero((rank == np.repeat(best, length)) & ~done)
        # of places that overlap, every second one from the left; of an unsafe rank, the leftmost place only
        run = np.append(True, np.diff(hit) != 1)
        run_at = np.flatnonzero(run)
        even = (np.arange(len(hit)) - np.repeat(run_at, np.diff(np.append(run_at, len(hit))))) % 2 == 0
        leftmost = np.append(True, seq[hit][1:] != seq[hit][:-1])
        hit = hit[np.where(v.alone[piece[hit]], leftmost, even)]
        sym[hit] = piece[hit]
        keep = ~done
        keep[hit + 1] = False
        sym, seq = sym[keep], seq[keep]
    return out


def count_symbols_long(points: np.ndarray, starts: np.ndarray, v: Vocabulary) -> np.ndarray:
    """As :func:`count_symbols`, with work in proportion to the merges whatever the length of a pre-token.

    The places of the lowest rank are merged at once. Where that puts a better pair beside a place, the places
    that follow near by wait until it is merged: no merge reaches further than the longest piece.
    """
    n, m = len(starts), len(points)
    seq = np.repeat(np.arange(n), np.diff(np.append(starts, m)))
    # a symbol without pairs stands between pre-tokens, before the first and after the last
    at = np.arange(m) + seq + 1
    wall = v.width - 1
    sym = np.full(m + n + 1, wall, np.int64)
    sym[at] = _symbols(points, v)
    after, before = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
    after[-1] = len(sym) - 1
    alive = np.ones(len(sym), bool)
    known = np.full(len(sym), NO_RANK)  # rank of the pair that begins here
    waiting: dict[int, list[np.ndarray]] = {}
    order: list[int] = []

    def pieces(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * v.width + right
        where = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
        piece = np.where(v.pairs[where] == key, v.merged[where], -1)
        return piece, np.where(piece >= 0, v.rank[piece], NO_RANK)

    def note(places: np.ndarray) -> None:
        rank = pieces(sym[places], sym[after[places]])[1]
        known[places] = rank
        places, rank = places[rank < NO_RANK], rank[rank < NO_RANK]
        if not len(places):
            return
        by = np.argsort(rank, kind="stable")
        places, rank = places[by], rank[by]
        cuts = np.flatnonzero(np.diff(rank)) + 1
        for r, group in zip(rank[np.append(0, cuts)].tolist(), np.split(places, cuts), strict=True):
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(order, r)
            waiting[r].append(group)

    note(at)
    while order:
        r = heapq.heappop(order)
        hit = np.unique(np.concatenate(waiting.pop(r)))
        hit = hit[alive[hit] & (known[hit] == r)]
        if not len(hit):
            continue
        run_at = np.flatnonzero(np.append(True, after[hit[:-1]] != hit[1:]))
        even = (np.arange(len(hit)) - np.repeat(run_at, np.diff(np.append(run_at, len(hit))))) % 2 == 0
        every, hit = hit, hit[even]
        piece = pieces(sym[hit], sym[after[hit]])[0]
        if v.alone[piece].any():
            left, right = sym[before[hit]], sym[after[after[hit]]]
            left[1:] = np.where(after[after[hit[:-1]]] == hit[1:], piece[:-1], left[1:])
            better = (pieces(left, piece)[1] < r) | (pieces(piece, right)[1] < r)
            if better.any():
                near = np.append(True, np.diff(hit) > 2 * v.longest + 2)
                first = np.flatnonzero(near)
                earlier = np.cumsum(better) - better
                late = earlier > np.repeat(earlier[first], np.diff(np.append(first, len(hit))))
                if late.any():
                    waiting[r] = [every]
                    heapq.heappush(order, r)
                    hit, piece = hit[~late], piece[~late]
        gone = after[hit]
        sym[hit] = piece
        alive[gone] = False
        after[hit] = after[gone]
        before[after[hit]] = hit
        note(np.unique(np.concatenate([hit, before[hit]])))
    left = at[alive[at]]
    weight = np.where(sym[left] > v.unknown, sym[left] - v.unknown, 1)
    return np.bincount(seq[alive[at]], weight, n).astype(np.int64)


class Counter:
    """Counts tokens batch by batch and remembers the counts of pre-tokens met before."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.known = np.empty(0, np.uint64)
        self.counts = np.empty(0, np.int64)

    def count(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        texts = pc.replace_substring(texts, SPACE, " ")
        filled = pc.greater(pc.binary_length(texts), 0)
        texts = pc.if_else(filled, pc.binary_join_element_wise(" ", texts, ""), "")  # the model's leading space
        data, offsets = textops.text_bytes(texts)
        if not len(data):
            return np.zeros(len(texts), np.int64)
        space, line = data == 32, data == 10
        first = space.copy()
        first[1:] &= ~space[:-1]
        first |= line
        first[1:] |= line[:-1]
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(first)
        hashes = textops.segment_hash(data.astype(np.uint64) + np.uint64(1), starts)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        old = self.known[at] == distinct if len(self.known) else np.zeros(len(distinct), bool)
        counts = np.zeros(len(distinct), np.int64)
        counts[old] = self.counts[at[old]]
        if (~old).any():
            counts[~old] = self._fresh(data, starts, where[~old])
            known = np.concatenate([self.known, distinct[~old]]) if len(self.known) < REMEMBERED else distinct
            values = np.concatenate([self.counts, counts[~old]]) if len(self.known) < REMEMBERED else counts
            order = np.argsort(known)
            self.known, self.counts = known[order], values[order]
        total = np.concatenate([[0], np.cumsum(counts[inverse])])
        begin = np.searchsorted(starts, offsets)
        return total[begin[1:]] - total[begin[:-1]]

    def _fresh(self, data: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
        ends = np.append(starts[1:], len(data))
        length = ends[which] - starts[which]
        at = np.concatenate([[0], np.cumsum(length)])
        place = np.repeat(starts[which] - at[:-1], length) + np.arange(at[-1])
        raw = data[place]
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
        points[points == 32] = ord(SPACE)
        characters = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        begin, size = characters[at[:-1]], np.diff(characters[at])
        long = size > LONG
        if not long.any():
            return count_symbols(points, begin, self.v)
        out = np.empty(len(which), np.int64)
        inside = np.repeat(long, size)
        for some, counted, of in ((long, count_symbols_long, inside), (~long, count_symbols, ~inside)):
            if some.any():
                out[some] = counted(points[of], np.cumsum(size[some]) - size[some], self.v)
        return out


def token_counts(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per row of ``df``: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    A NULL or empty text has no bytes and no tokens. Rows that repeat are counted each; ids may be NULL. Other
    columns of ``df`` are not looked at. An empty table gives no rows. No shuffle: a map over the scan.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(tuple(load_vocabulary(model_file)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(Vocabulary(*vocabulary.value))
        for batch in batches:
            for part in textops.slices(batch, "text"):
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                n = counter.count(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), size, pa.array(n, pa.int64()), pa.array(n > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
