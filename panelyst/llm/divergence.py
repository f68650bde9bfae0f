"""How the sources of a language differ in their terms: exact counts, smoothed shares and divergences.

Terms are cut from the bytes of whole texts. Inside a batch of documents, ordered by language and source, they
are counted by their length in bytes:

* up to 8 bytes make one 64-bit word and up to 16 make two; such terms are radix-sorted by digits of 16 bits,
  and runs of equal words are counted;
* longer terms stand in a bucket for each length and are sorted as byte strings.

The sorts are stable, so the places of a term stay in the order of their documents, and the same pass over runs
gives occurrences and documents. Spark adds the counts up by language and term. Sums over all terms of a language
need those terms only which one of two sources has; each of the others adds the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyst.llm import textops
from panelyst.sources.sinks import materialise

BATCH_BYTES = 1 << 23
#: Sources that meet in one block of the comparison, and (term, source) counts in one of its buckets, about.
BLOCK, BUCKET = 64, 200_000
#: The scale of shares.
SCALE = 1_000_000_000

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows by 64-bit words, the last word first in weight, by digits of 16 bits."""
    order = np.arange(len(words[0]))
    for word in words:
        for shift in range(0, 64, 16):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _word(data: np.ndarray, starts: np.ndarray, length: np.ndarray, skip: int) -> np.ndarray:
    """Bytes ``skip`` to ``skip + 8`` of each term as a number, the first byte highest, zeros behind its end."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(8):
        has = np.flatnonzero(length > skip + k)
        out[has] |= data[starts[has] + skip + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def count_terms(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first byte, length, group, occurrences, documents) of each term of each group.

    ``data`` are the bytes of texts of ascending ``group`` with A-Z in lower case.
    """
    letter = LETTER[data]
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    edge = offsets[:-1][np.diff(offsets) > 0]
    first[edge] = letter[edge]
    last[edge[1:] - 1] = letter[edge[1:] - 1]
    starts = np.flatnonzero(first)
    length = np.flatnonzero(last) + 1 - starts
    doc = np.searchsorted(offsets, starts, side="right") - 1
    out = []
    for lo, hi in ((1, 8), (9, 16)):
        own = np.flatnonzero((length >= lo) & (length <= hi))
        words = [_word(data, starts[own], length[own], skip) for skip in range(0, hi, 8)]
        order = radix_order(words[::-1])
        change = np.zeros(max(len(own) - 1, 0), bool)
        for word in words:
            change |= np.diff(word[order]) != 0
        out.append((own[order], change))
    wide = np.flatnonzero(length > 16)
    wide = wide[np.argsort(length[wide], kind="stable")]
    cuts = np.flatnonzero(np.diff(length[wide])) + 1
    for own in np.split(wide, cuts) if len(wide) else ():
        size = int(length[own[0]])
        raw = data[starts[own][:, None] + np.arange(size)].view(f"S{size}").ravel()
        order = np.argsort(raw, kind="stable")
        out.append((own[order], raw[order][1:] != raw[order][:-1]))
    found = []
    for own, change in out:
        if not len(own):
            continue
        docs = doc[own]
        groups = group[docs]
        new = np.append(True, change | (np.diff(groups) != 0))
        at = np.flatnonzero(new)
        new_doc = new | np.append(True, np.diff(docs) != 0)
        n = np.diff(np.append(at, len(own)))
        found.append((starts[own[at]], length[own[at]], groups[at], n, np.add.reduceat(new_doc.astype(np.int64), at)))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of each term, in parts that are yet to be added up.

    ``docs`` has lang, source and text without NULL.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.slices(batch, "text", BATCH_BYTES):
                code, size = np.zeros(part.num_rows, np.int64), 1
                for name in ("lang", "source"):
                    own = part.column(name).dictionary_encode()
                    code = code * (len(own.dictionary) + 1) + own.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                part = part.take(pa.array(order))
                _, first, group = np.unique(code[order], return_index=True, return_inverse=True)
                data, offsets = textops.text_bytes(part.column("text"))
                data = LOWER[data]
                starts, length, of, n, df = count_terms(data, offsets, group)
                row = pa.array(first[of])
                columns = [part.column("lang").take(row), part.column("source").take(row), textops.strings(data, starts, length), pa.array(n), pa.array(df)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "df"])

    return docs.mapInArrow(run, "lang string, source string, term string, n long, df long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), in whole numbers."""
    over = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    under = (total + 2 * terms).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", over, under)


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)) of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _block_sums(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums of divergences over the terms of a bucket, for the pairs of sources of two blocks.

    ``left``: term, place of the source, share; ``right``: lang, place, block, share of an absent term of each source.
    """
    place = right["place"].to_numpy()
    order = np.argsort(place)
    place, block, absent = place[order], right["block"].to_numpy()[order], right["absent"].to_numpy()[order]
    terms = left["term"].combine_chunks().dictionary_encode()
    row = terms.indices.to_numpy()
    column = np.searchsorted(place, left["place"].to_numpy())
    value = left["p"].to_numpy()
    by_row = np.argsort(row, kind="stable")
    row, column, value = row[by_row], column[by_row], value[by_row]
    total = np.zeros((len(place), len(place)), np.int64)
    step = max(1, (1 << 19) // max(len(place), 1))
    for a in range(0, len(terms.dictionary), step):
        lo, hi = np.searchsorted(row, [a, a + step])
        p = np.tile(absent, (min(step, len(terms.dictionary) - a), 1))
        p[row[lo:hi] - a, column[lo:hi]] = value[lo:hi]
        for i in range(len(place) - 1):
            gap = p[:, i + 1 :] - p[:, i : i + 1]
            total[i, i + 1 :] += (gap * gap // (p[:, i + 1 :] + p[:, i : i + 1])).sum(axis=0)
    i, j = np.triu_indices(len(place), 1)
    if block[0] != block[-1]:  # pairs inside a block are summed where it meets itself
        across = block[i] != block[j]
        i, j = i[across], j[across]
    lang = right["lang"][:1].to_pylist() * len(i)
    return pa.table({"lang": pa.array(lang, pa.string()), "a": place[i], "b": place[j], "total": total[i, j], "terms": np.full(len(i), len(terms.dictionary))})


def audit(df: DataFrame, least_documents: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): divergences of sources and the terms that mark each.

    Part ``pair`` has each other source of the language, ranked by divergence, and ``term`` the ``top`` terms that
    the source has more often than its language. NULL in text, lang or source is an empty string; rows that repeat
    count each; ids and other columns are not looked at. A source without terms has its pairs; a language without
    terms in ``least_documents`` documents has pairs of value 0. An empty table gives no rows.
    """
    docs = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    in_term = Window.partitionBy("lang", "term")
    counts = (
        term_counts(docs)
        .repartition("lang", "term")  # parts of a batch are summed already
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
        .withColumn("everywhere", F.sum("df").over(in_term))
        .where(F.col("everywhere") >= least_documents)
        .withColumn("n_lang", F.sum("n").over(in_term))
        .select("lang", "term", "source", "n", "n_lang")
    )
    counts = materialise(counts, "counts")
    # one row for each source of a language from here on
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = counts.groupBy("lang").agg(F.count_distinct("term").alias("terms"))
    by_place = Window.partitionBy("lang").orderBy("source")
    in_lang = Window.partitionBy("lang")
    groups = (
        docs.groupBy("lang", "source")
        .agg(F.count(F.lit(1)).alias("n_docs"))
        .join(sizes, ["lang", "source"], "left")
        .join(terms, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms")])
        .withColumn("place", (F.row_number().over(by_place) - 1).cast("long"))
        .withColumn("block", F.floor(F.col("place") / BLOCK))
        .withColumn("blocks", F.max("block").over(in_lang) + 1)
        .withColumn("n_all", F.sum("total").over(in_lang))
        .withColumn("absent", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))))
    )
    groups = materialise(groups, "groups")
    rows = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))

    q = share(F.col("n_lang"), F.col("n_all"), F.col("terms"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    marks = (
        rows.withColumn("q", q)
        .where(F.col("p") > F.col("q"))
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(by_value))
        .where(F.col("rank") <= top)
    )

    pairs = _pair_values(rows, groups, counts.count())
    ranked = pairs.withColumn("rank", F.row_number().over(by_value))
    return ranked.unionByName(marks)


def _pair_values(rows: DataFrame, groups: DataFrame, n_rows: int) -> DataFrame:
    """The divergence of each source from each other source of its language."""
    buckets = 1 + n_rows // BUCKET
    meet = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    both = [F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")]
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets))
    left = rows.select("lang", "term", "place", "p", "block", meet.alias("other")).select("lang", *both, bucket.alias("bucket"), "term", "place", "p")
    right = groups.where("terms > 0").select("lang", "place", "block", "absent", meet.alias("other"))
    right = right.select("lang", *both, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)).cast("array<long>")).alias("bucket"), "place", "block", "absent")
    right = right.toDF(*right.columns)  # columns of its own: both sides come from ``groups``
    key = ["lang", "lo", "hi", "bucket"]
    sums = (
        left.groupBy(*key)
        .cogroup(right.groupBy(*key))
        .applyInArrow(_block_sums, "lang string, a long, b long, total long, terms long")
        .groupBy("lang", "a", "b")
        .agg(F.sum("total").alias("total"), F.sum("terms").alias("met"))
    )
    one = groups.select("lang", "source", F.col("place").alias("one"), F.col("absent").alias("p"), "terms")
    two = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("two"), F.col("absent").alias("q"))
    pairs = one.join(two, "lang").where("one <> two").select("*", F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b"))
    rest = F.coalesce((F.col("terms") - F.coalesce("met", F.lit(0))) * apart(F.col("p"), F.col("q")), F.lit(0))
    value = F.coalesce("total", F.lit(0)) + rest
    return pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
