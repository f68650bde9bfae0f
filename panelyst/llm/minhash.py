"""MinHash near-duplicates by an inverted join of signature coordinates, confirmed on full shingle sets.

1. Every text gets the set of its five-word shingles and COORDINATES minima of it. Texts with equal sets form a
   class; all further work is on classes.
2. Two sets of similarity 0.75 agree in MATCHES coordinates or more, but for one pair in 200,000. With the
   pairs of coordinate and value ordered from rare to frequent, they so agree in one of the first COORDINATES -
   MATCHES + 1 of each: only this prefix is posted, the rest is skipped over and looked at when collisions are
   counted. A class whose rarest values are its own posts nothing, so texts that share a passage only do not
   meet. The smallest class of a posting list is its hub, and all classes that share a hub meet.
3. Each class meets its hub first; those that match it hang together and need not meet each other. Only the others
   meet all of the hub, in blocks of bounded size, each pair of blocks once. Collisions are counted there; a block
   passes on, for each class with a match, the smallest class it hangs together with. What hangs together is a
   cluster, and every link lies inside one.
4. Classes of a cluster meet again with their full sets, the smallest first, then in blocks as before. Matching pairs are confirmed
   exactly unless the block already holds them together; confirmed links are passed on. Their components are
   the groups of near-duplicates.

No step makes a row for each pair, and no task sees more than two blocks of classes at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyst.llm import textops
from panelyst.llm.graph import components
from panelyst.sources.sinks import materialise

COORDINATES = 64
MATCHES = 32
#: Classes of a block: where they bring their signatures, and where they bring their full sets.
SIGNATURE_BLOCK, SET_BLOCK = 2048, 256
_RNG = np.random.default_rng(4)
FACTORS = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
MASKS = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Sets x COORDINATES: the upper halves of the minima of each set under each hash; 0 for an empty set."""
    out = np.zeros((len(sets), COORDINATES), np.uint32)
    n = np.array([len(s) for s in sets], np.int64)
    if n.sum():
        flat = np.concatenate(sets)
        begin = (np.cumsum(n) - n)[n > 0]
        for k in range(COORDINATES):
            least = np.minimum.reduceat((flat ^ MASKS[k]) * FACTORS[k], begin)
            out[n > 0, k] = (least >> np.uint64(32)).astype(np.uint32)
    return out


def _fingerprint(s: np.ndarray) -> bytes:
    """16 bytes that tell sets apart."""
    return np.array([textops.mix(s).sum(), textops.mix(s ^ np.uint64(textops.BASE)).sum() + np.uint64(len(s))], np.uint64).tobytes()


def _sign(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, "text"):
                sets = textops.shingle_sets(part.column("text"))
                sig = pa.array(signatures(sets).view(np.int32).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_hash"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_fingerprint(s) for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * COORDINATES), sig),
                    ],
                    ["doc_id", "text_hash", "n_shingles", "fingerprint", "sig"],
                )

    return rows.mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, fingerprint binary, sig array<int>"
    )


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, whichever batches they came in."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(int(c[a]) for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


class Union:
    """Union-find over places 0..n-1; the root is the smallest place."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = sorted((self.root(i), self.root(j)))
        self.up[j] = i


def matches(sig: np.ndarray, side: np.ndarray, one_block: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j) that agree in MATCHES coordinates, most agreements first, and their agreements.

    Within one block every pair counts once; of two blocks only pairs across.
    """
    left = np.arange(len(sig)) if one_block else np.flatnonzero(side == 0)
    right = left if one_block else np.flatnonzero(side == 1)
    found = []
    for at in range(0, len(left), 32):
        rows = left[at : at + 32]
        same = (sig[rows][:, None, :] == sig[right][None]).sum(2, dtype=np.int16)
        i, j = np.nonzero(same >= MATCHES)
        found.append((rows[i], right[j], same[i, j]))
    if not found:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    i, j, n = (np.concatenate(x) for x in zip(*found, strict=True))
    if one_block:
        i, j, n = i[i < j], j[i < j], n[i < j]
    order = np.argsort(-n, kind="stable")
    return i[order], j[order], n[order]


def _edges(ids: np.ndarray, union: Union) -> pa.RecordBatch:
    """(a, b) for each place that hangs together with another: its id and the id of its root."""
    pairs = [(ids[k], ids[union.root(k)]) for k in range(len(ids)) if union.root(k) != k]
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _members(classes: DataFrame) -> DataFrame:
    """(hub, cid): which classes (cid, sig) meet, by the inverted lists of their prefixes."""
    value = F.col("value").cast("long").bitwiseAND(0xFFFFFFFF)
    postings = classes.select("cid", F.posexplode("sig").alias("at", "value")).select(
        "cid", F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(value).alias("key")
    )
    lists = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ordered = postings.join(lists, "key").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))
    prefix = F.slice("keys", F.lit(1), F.size("keys") - (MATCHES - 1))  # values of one class alone come first, unlisted
    posted = ordered.where(F.size("keys") >= MATCHES).select("cid", F.explode(prefix).alias("k")).select("cid", "k.key")
    posted = materialise(posted, "posted")
    hubs = posted.groupBy("key").agg(F.min("cid").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return posted.join(hubs, "key").select("hub", "cid").distinct()


def _meet(
    members: DataFrame, key: str, payload: DataFrame, column: str, alike: Callable, judge: Callable, block: int
) -> DataFrame:
    """Edges among the members (key, cid) of each key, the smallest of which is its head.

    Every member meets the head first, and ``alike`` tells which are linked to it. Those hang together and need not
    meet each other: only the others meet all, in pairs of blocks, where ``judge`` finds edges. ``payload``
    (cid, column) is what a member brings along.
    """
    heads = payload.select(F.col("cid").alias(key), F.col(column).alias("head"))
    facing = members.where(F.col("cid") != F.col(key)).join(payload, "cid").join(heads, key).select(key, "cid", column, "head")

    def face(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = pa.array(alike(batch.column(column), batch.column("head")), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("cid"), linked], [key, "cid", "linked"])

    faced = materialise(facing.mapInArrow(face, f"{key} long, cid long, linked boolean"), "faced")
    sizes = faced.groupBy(key).agg(
        F.ceil(F.count_if(~F.col("linked")) / block).cast("int").alias("open"),
        F.ceil(F.count_if("linked") / block).cast("int").alias("closed"),
    )
    sizes = materialise(sizes.where("open > 0"), "sizes")
    number = F.xxhash64("cid")
    own = F.when(F.col("linked"), F.col("open") + F.pmod(number, F.col("closed"))).otherwise(F.pmod(number, F.col("open"))).cast("int")
    others = F.when(F.col("linked"), F.col("open")).otherwise(F.col("open") + F.col("closed"))
    dealt = (
        faced.join(sizes, key)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
        .select(key, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "cid")
    )
    keys = [key, "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, keys):
            if group.num_rows > 1:
                one_block = group["lo"][0].as_py() == group["hi"][0].as_py()
                side = (group["own"].to_numpy() != group["lo"][0].as_py()).astype(np.int8)
                yield judge(group["cid"].to_numpy(), group[column].combine_chunks(), side, one_block)

    met = dealt.join(payload, "cid").repartition(*keys).sortWithinPartitions(*keys, "cid")
    found = met.select(*keys, "own", "cid", column).mapInArrow(run, "a long, b long")
    return faced.where("linked").select(F.col("cid").alias("a"), F.col(key).alias("b")).unionByName(found)


def _rows_of(sig: pa.Array) -> np.ndarray:
    return sig.flatten().to_numpy().reshape(len(sig), COORDINATES)


def _alike_signatures(own: pa.Array, head: pa.Array) -> np.ndarray:
    return (_rows_of(own) == _rows_of(head)).sum(1) >= MATCHES


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """If 100 times the common elements of two sorted sets are ``percent`` times the united or more."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _alike_sets(percent: int) -> Callable:
    def alike(own: pa.Array, head: pa.Array) -> list[bool]:
        pairs = zip(own, head, strict=True)
        return [_linked(*(np.frombuffer(x.as_buffer(), np.uint64) for x in pair), percent) for pair in pairs]

    return alike


def _by_signature(ids: np.ndarray, sig: pa.Array, side: np.ndarray, one_block: bool) -> pa.RecordBatch:
    i, j, _ = matches(_rows_of(sig), side, one_block)
    union = Union(len(ids))
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        union.join(x, y)
    return _edges(ids, union)


def _by_sets(percent: int) -> Callable:
    def judge(ids: np.ndarray, packed: pa.Array, side: np.ndarray, one_block: bool) -> pa.RecordBatch:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in packed]
        union = Union(len(ids))
        i, j, _ = matches(signatures(sets), side, one_block)
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if union.root(x) != union.root(y) and _linked(sets[x], sets[y], percent):
                union.join(x, y)
        return _edges(ids, union)

    return judge


def _sets(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, "text"):
                packed = pa.array([s.tobytes() for s in textops.shingle_sets(part.column("text"))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("cid"), packed], ["cid", "packed"])

    return rows.mapInArrow(run, "cid long, packed binary")


def near_duplicates(
    docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", blocks: tuple[int, int] = (SIGNATURE_BLOCK, SET_BLOCK)
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, text_hash, root.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. Rows are linked if 100 times the common shingles
    are ``percent`` (75 or more) times the united; component_id is the smallest doc_id that can be reached. A
    NULL, empty or blank text has no shingles and is linked with nothing. Rows may repeat, with or without
    their ids: equal texts are always linked. A NULL id counts for nothing: a component without any id has a
    NULL component_id, and rows without one are kept only if their component has no id. ``text_hash`` is the
    xxhash64 of the text and tells rows with the same id apart; ``root`` is a number of the component, NULL
    for a text without shingles.
    """
    if percent < 75:
        raise ValueError("the signatures are laid out for 75 per cent or more")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
        F.col(text_col).cast("string").alias("text"),
    )
    signed = materialise(_sign(rows), "signed")
    classes = materialise(
        signed.where("n_shingles > 0")
        .groupBy("fingerprint")
        .agg(
            F.min("doc_id").alias("least"),
            F.min(F.struct("doc_id", "text_hash")).alias("rep"),
            F.first("sig").alias("sig"),
        )
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    members = materialise(_members(classes), "members")
    clusters = components(_meet(members, "hub", classes.select("cid", "sig"), "sig", _alike_signatures, _by_signature, blocks[0]))
    clustered = clusters.select(F.col("a").alias("cid"), F.col("b").alias("cluster")).unionByName(
        clusters.select(F.col("b").alias("cid"), F.col("b").alias("cluster")).distinct()
    )
    wanted = clustered.join(classes.select("cid", "rep.doc_id", "rep.text_hash"), "cid").alias("w")
    texts = rows.alias("r").join(
        wanted, (F.col("r.text_hash") == F.col("w.text_hash")) & F.col("r.doc_id").eqNullSafe(F.col("w.doc_id"))
    )
    sets = materialise(_sets(texts.select("w.cid", "r.text")), "sets")
    links = components(_meet(clustered, "cluster", sets, "packed", _alike_sets(percent), _by_sets(percent), blocks[1]))
    root = F.coalesce(F.col("b"), F.col("cid"))
    rooted = classes.join(links.withColumnRenamed("a", "cid"), "cid", "left").select("fingerprint", "least", root.alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(heads, "root").select("fingerprint", "component_id", "root")
    found = signed.select("doc_id", "n_shingles", "fingerprint", "text_hash").join(
        of_class, "fingerprint", "left"
    )
    head = F.when(F.col("root").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id",
        "n_shingles",
        head.alias("component_id"),
        F.coalesce(F.col("doc_id").eqNullSafe(head), F.lit(False)).alias("kept"),
        "text_hash",
        "root",
    )


def one_of_each(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near-duplicates, with all its columns: that with the smallest id, rows
    without an id last, then the smallest hash of the text. Rows without shingles stay, all but equal ones.
    """
    found = near_duplicates(docs, percent, id_col, text_col)
    linked = found.where(F.col("root").isNotNull())
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    chosen = linked.groupBy("root").agg(F.min(order).alias("one")).select("one.kept_id", "one.kept_hash")
    alone = found.where(F.col("root").isNull()).select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    kept = chosen.unionByName(alone.distinct())
    marked = docs.withColumn("__hash", F.xxhash64(F.col(text_col).cast("string")))
    same = (F.col("d.__hash") == F.col("k.kept_hash")) & F.col(f"d.`{id_col}`").cast("long").eqNullSafe(F.col("k.kept_id"))
    stays = marked.alias("d").join(kept.alias("k"), same, "left_semi")
    return stays.dropDuplicates([id_col, "__hash"]).drop("__hash")
