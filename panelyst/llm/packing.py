"""Packing of token sequences into windows by minimum bin slack, without padding.

Every document is encoded, an end id follows, and its ids are cut at multiples of the window. What remains
of a document is shorter than a window. The counts of remainders by length are all that planning needs:

* The longest length left is the seed of a window. A bitset dynamic programme over the other lengths and
  their counts finds the multiset that comes closest to the room beside it; it is backtracked into a count
  of each length and applied as often as the counts allow. Each step uses up a length, so there are at most
  about as many patterns as lengths, however many documents there are.
* Where the closest multiset leaves a gap, no later window can do better for that seed, and the remainders
  of its length are cut into powers of two instead. Laid end to end from large to small, such parts never
  cross the end of a window, and the last window falls into sequences that are powers of two.

A row finds its place by its rank among the rows of its length: its number in the task that encoded it, and
how many rows of that length earlier tasks have. The ids themselves are never moved or stored: the checksums
of a remainder's parts are taken while it is encoded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyst.llm import textops
from panelyst.sources.sinks import materialise

#: Chunks whose ids a task remembers at a time, and chunks that are encoded as one text.
REMEMBERED, TOGETHER = 1 << 19, 1000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long"


#: ASCII letters and digits (1), and marks (2) that no contraction or added token has.
KIND = np.zeros(256, np.uint8)
KIND[[c for c in range(128) if chr(c).isalnum()]] = 1
KIND[[*b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"]] = 2


class Encoder:
    """Ids of whole texts; what stands between white space is encoded once and remembered.

    The tokenizer must treat a text as its chunks between ASCII white space, one after another, as those do that
    drop white space. Where it parts letters from marks, so do chunks. They are known by a 64-bit hash, of lower-case
    letters if the tokenizer lowers them.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(tokenizer_json)
        self.model.no_padding()
        self.model.no_truncation()
        self.special = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        before = self.model.pre_tokenizer
        self.parts = before is not None and len(before.pre_tokenize_str("ab,1-cd")) == 5
        self.lowers = self.model.normalizer is not None and self.model.normalizer.normalize_str("AZ") == "az"
        suffix = getattr(self.model.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix and self.parts:
            self.ends = np.zeros(self.model.get_vocab_size(), bool)
            self.ends[[i for token, i in self.model.get_vocab().items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.entry = np.empty(0, np.int64)
        self.at = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _learn(self, fresh: np.ndarray, chunks: list[str]) -> None:
        plain = np.fromiter((self.ends is not None and c.isascii() and c.isalpha() for c in chunks), bool, len(chunks))
        words = [c for c, p in zip(chunks, plain.tolist(), strict=True) if p]
        flat, length = self._words(words)
        found = [e.ids for e in self.model.encode_batch_fast([c for c, p in zip(chunks, plain.tolist(), strict=True) if not p], add_special_tokens=False)]
        length = np.append(length, np.fromiter(map(len, found), np.int64, len(found)))
        self.ids = np.concatenate([self.ids, flat, np.fromiter(chain.from_iterable(found), np.uint32)])
        known = np.concatenate([self.known, fresh[plain], fresh[~plain]])
        entry = np.concatenate([self.entry, len(self.at) - 1 + np.arange(len(fresh))])
        order = np.argsort(known)
        self.known, self.entry = known[order], entry[order]
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(length)])

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of ASCII letters one after another, and how many each has: many words make one text."""
        texts = [" ".join(words[k : k + TOGETHER]) for k in range(0, len(words), TOGETHER)]
        found = self.model.encode_batch_fast(texts, add_special_tokens=False)
        flat = np.concatenate([np.array(e.ids, np.uint32) for e in found] or [np.empty(0, np.uint32)])
        if not len(words):
            return flat, np.empty(0, np.int64)
        last = np.flatnonzero(self.ends[flat])
        if len(last) != len(words):
            raise ValueError("the tokenizer does not end each word with a token that ends a word")
        return flat, np.diff(last, prepend=-1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where those of each begin (one entry more than texts)."""
        data, offsets = textops.text_bytes(texts)
        raw = data.tobytes()
        # added tokens are found before letters are lowered
        fold = self.lowers and not any(t.lower() in raw.lower() for t in self.special)
        space = textops.SEPARATOR[data]
        first = np.append(True, space[:-1])[: len(data)]
        if self.parts:
            first[1:] |= KIND[data[1:]] + KIND[data[:-1]] == 3
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(first & ~space)
        begin = np.searchsorted(starts, offsets)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        hashes = textops.segment_hash((textops.FOLD if fold else textops.KEEP_CASE)[data], starts)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        fresh = ~np.isin(distinct, self.known, assume_unique=True)
        if fresh.any():
            end = np.append(np.flatnonzero(first | space), len(data))
            at = starts[where[fresh]]
            stop = end[np.searchsorted(end, at, side="right")]
            self._learn(distinct[fresh], [raw[a:b].decode("utf-8") for a, b in zip(at.tolist(), stop.tolist(), strict=True)])
        entry = self.entry[np.searchsorted(self.known, distinct)][inverse]
        length = self.at[entry + 1] - self.at[entry]
        end = np.cumsum(length)
        ids = self.ids[np.repeat(self.at[entry] - end + length, length) + np.arange(end[-1])]
        return ids, np.append(0, end)[begin]


def cut_into_pieces(ids: np.ndarray, begin: np.ndarray, capacity: int, end_id: int) -> dict[str, np.ndarray | list]:
    """Pieces of texts whose ids are given: full windows and one remainder each, the end id included.

    ``text`` is the number of the text. ``parts`` are checksums of the powers of two that a remainder falls into,
    the largest first.
    """
    n = len(begin) - 1
    tokens = np.diff(begin) + 1
    own = begin + np.arange(n + 1)
    flat = np.full(int(own[-1]), end_id, "<u4")
    flat[np.arange(len(ids)) + np.repeat(np.arange(n), tokens - 1)] = ids
    made = -(-tokens // capacity)
    text = np.repeat(np.arange(n), made)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(made) - made, made)) * capacity
    length = np.minimum(tokens[text] - start, capacity)
    raw = memoryview(flat.tobytes())
    crc, parts = [], []
    for a, size in zip((own[text] + start).tolist(), length.tolist(), strict=True):
        crc.append(zlib.crc32(raw[4 * a : 4 * (a + size)]))
        own_parts = []
        if size < capacity:
            bit = capacity >> 1
            while bit:
                if size & bit:
                    own_parts.append(zlib.crc32(raw[4 * a : 4 * (a + bit)]))
                    a += bit
                bit >>= 1
        parts.append(own_parts)
    return {"text": text, "start": start, "length": length, "crc": np.array(crc, np.int64), "doc_tokens": tokens[text], "parts": parts}


def closest(counts: Mapping[int, int], room: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to ``room`` of lengths taken up to their counts, and how many of each make it."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for size in sorted((s for s in counts if s <= room and counts[s] > 0), reverse=True):
        steps.append((size, reach))
        left, chunk = min(counts[size], room // size), 1
        while left:
            chunk = min(chunk, left)
            reach |= (reach << (size * chunk)) & mask
            left -= chunk
            chunk *= 2
        if reach >> room & 1:
            break
    best = at = reach.bit_length() - 1
    taken = {}
    for size, before in reversed(steps):
        k = 0
        while not before >> (at - k * size) & 1:
            k += 1
        if k:
            taken[size] = k
            at -= k * size
    return best, taken


class Plan(NamedTuple):
    """Where the pieces of each length go, by their rank among those of that length.

    The rows of ``length`` ranked from ``rank`` on (up to the next entry) fill the windows from ``sequence`` on with
    ``each`` to a window, the first at ``offset``; or, with ``each`` 0, they are cut. Parts of size 2^k of cut
    pieces of a length lie one after another from ``parts[k, length]`` on, in a row of ids that begins with the
    window ``cut_sequence`` and has ``cut_ids`` ids.
    """

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    parts: np.ndarray
    cut_sequence: int
    cut_ids: int


def plan_windows(counts: Mapping[int, int], capacity: int) -> Plan:
    """Minimum bin slack over the counts of pieces by length (at most ``capacity`` of them)."""
    left = {s: n for s, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    entries, sequence = [], 0
    cut = {}
    while left:
        seed = max(left)
        left[seed] -= 1
        room = capacity - seed
        best, taken = closest(left, room) if room else (0, {})
        left[seed] += 1
        taken[seed] = taken.get(seed, 0) + 1
        if best < room:
            entries.append((seed, used[seed], 0, 0, 0))
            cut[seed] = left.pop(seed)
            continue
        times = min(left[s] // k for s, k in taken.items())
        offset = 0
        for s, k in sorted(taken.items(), reverse=True):
            entries.append((s, used[s], sequence, k, offset))
            offset += s * k
            used[s] += times * k
            left[s] -= times * k
            if not left[s]:
                del left[s]
        sequence += times
    parts = np.zeros((capacity.bit_length(), capacity + 1), np.int64)
    at = 0
    for k in reversed(range(capacity.bit_length())):
        for size, n in sorted(cut.items(), reverse=True):
            if size >> k & 1:
                parts[k, size] = at
                at += n << k
    columns = np.array(sorted(entries), np.int64).reshape(-1, 5).T
    return Plan(*columns, parts, sequence, at)


def place_pieces(plan: Plan, length: np.ndarray, rank: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """(piece, part, shift, size, sequence, offset): a row for each whole piece (part -1) and each part of a cut one.

    ``part`` counts the parts of a piece and ``shift`` is where in the piece it begins.
    """
    # ranks of one length ascend, so the entries are in the order of both
    order = np.lexsort((rank, length))
    key = np.searchsorted(plan.length, length, side="right")
    first = np.searchsorted(plan.length, length)
    entry = np.empty(len(length), np.int64)
    for a, b in zip(*_runs(length[order]), strict=True):
        own = order[a:b]
        lo, hi = first[own[0]], key[own[0]]
        entry[own] = lo + np.searchsorted(plan.rank[lo:hi], rank[own], side="right") - 1
    each, past = plan.each[entry], rank - plan.rank[entry]
    whole = np.flatnonzero(each > 0)
    at, slot = np.divmod(past[whole], each[whole])
    out = [(whole, np.full(len(whole), -1), np.zeros(len(whole), np.int64), length[whole], plan.sequence[entry[whole]] + at, plan.offset[entry[whole]] + slot * length[whole])]
    cut = np.flatnonzero(each == 0)
    part, shift = np.zeros(len(cut), np.int64), np.zeros(len(cut), np.int64)
    last = plan.cut_ids - plan.cut_ids % capacity
    for k in reversed(range(capacity.bit_length())):
        has = (length[cut] >> k & 1) == 1
        own = cut[has]
        ids = plan.parts[k, length[own]] + (past[own] << k)
        sequence, offset = plan.cut_sequence + ids // capacity, ids % capacity
        # the last window falls into a sequence for each power of two in its length
        tail, rest = ids >= last, plan.cut_ids - last
        before = 0
        for extra, bit in enumerate(b for b in reversed(range(capacity.bit_length())) if rest >> b & 1):
            inside = tail & (ids - last >= before) & (ids - last < before + (1 << bit))
            sequence[inside] = plan.cut_sequence + last // capacity + extra
            offset[inside] = ids[inside] - last - before
            before += 1 << bit
        out.append((own, part[has], shift[has], np.full(len(own), 1 << k), sequence, offset))
        part[has] += 1
        shift[has] += 1 << k
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin and end."""
    first = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])[: len(sorted_values)])
    return first, np.append(first[1:], len(sorted_values)) if len(first) else first


def encode_pieces(df: DataFrame, tokenizer_json: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """The pieces of all texts, with ``parts``, ``task`` and ``rank``: the number among the task's pieces of its length."""
    model = df.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary file, as large at any input
    schema = f"{PIECES}, parts array<long>, `rank` long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, seen = Encoder(model.value), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part in textops.slices(batch, "text"):
                made = cut_into_pieces(*encoder.encode(part.column("text")), capacity, end_id)
                length = made["length"]
                order = np.argsort(length, kind="stable")
                first, last = _runs(length[order])
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.repeat(first, last - first) + seen[length[order]]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [part.column("doc_id").take(pa.array(made["text"]))]
                columns += [pa.array(made[c], pa.int64()) for c in ("start", "length", "crc", "doc_tokens")]
                columns += [pa.array(made["parts"], pa.list_(pa.int64())), pa.array(rank)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "parts", "rank"]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumn("task", F.spark_partition_id())


def pack(df: DataFrame, tokenizer_json: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer_json`` is the content of a file of the tokenizers library; ``capacity`` is a power of two. Sequences
    are full or hold a power of two of ids, so none is padded. A NULL or empty text is its end id alone. Rows that
    repeat are packed each; ids may be NULL. An empty table gives no rows. Other columns are not looked at.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    spark = df.sparkSession
    pieces = materialise(encode_pieces(df, tokenizer_json, capacity, end_id, id_col, text_col), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # up to capacity rows
    plan = spark.sparkContext.broadcast(tuple(plan_windows(counts, capacity)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Plan(*plan.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            value = {c: batch.column(c).to_numpy() for c in ("start", "length", "ids_crc32", "rank")}
            piece, part, shift, size, sequence, offset = place_pieces(own, value["length"], value["rank"], capacity)
            crc = value["ids_crc32"][piece]
            lists = batch.column("parts")
            if isinstance(lists, pa.ChunkedArray):
                lists = lists.combine_chunks()
            begin = np.asarray(lists.offsets)
            inner = lists.values.to_numpy(zero_copy_only=False)
            cut = part >= 0
            crc[cut] = inner[begin[piece[cut]] + part[cut]]
            take = pa.array(piece)
            columns = [batch.column("doc_id").take(take), *map(pa.array, (value["start"][piece] + shift, size, crc))]
            columns += [batch.column("doc_tokens").take(take), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, PACKED.replace(" long", "").split(", "))

    ranked = pieces.join(base, ["task", "length"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "parts", (F.col("base") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(run, PACKED)
