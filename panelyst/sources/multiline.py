"""CSV records with line breaks in quoted fields, from files that many tasks read.

A task that starts in the middle of a file cannot tell whether it stands inside a quoted field. It can tell how
many quotes its lines have, and the parity of all quotes before it says where it stands. So a first pass brings a
few numbers for each split of a file: the parity of its quotes and whether a record would begin in it. The parities
of earlier splits, added up in the order of the file, say how each split begins. In a second pass each task puts
the lines of its records together; the pieces of records that reach over the end of a split are joined up, and they
are all that is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_SUMMARY = "file string, start long, odd boolean, begins_if_odd boolean, ends_in_return boolean"
_PIECES = "file string, start long, owner long, first boolean, whole boolean, record string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files under a path, with the file and where the split begins that they belong to."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _by_split():
    """Runs of lines of one split, as (file, start, lines, quotes of each line)."""

    def run(batches):
        import numpy as np
        import pyarrow.compute as pc

        for batch in batches:
            if not batch.num_rows:
                continue
            start = batch.column("start").to_numpy()
            files = batch.column("file").dictionary_encode()
            code = files.indices.to_numpy()
            cuts = np.flatnonzero((start[1:] != start[:-1]) | (code[1:] != code[:-1])) + 1
            edges = [0, *cuts.tolist(), len(start)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                lines = batch.column("value").slice(a, b - a)
                quotes = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False)
                yield files.dictionary[int(code[a])].as_py(), int(start[a]), lines, quotes

    return run


def _summaries():
    splits = _by_split()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["file", "start", "odd", "begins_if_odd", "ends_in_return"]
        now = None

        def flush():
            return pa.RecordBatch.from_pylist([dict(zip(names, now, strict=True))], schema)

        schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("odd", pa.bool_()), ("begins_if_odd", pa.bool_()), ("ends_in_return", pa.bool_())])
        for file, start, lines, quotes in splits(batches):
            if now is None or now[:2] != [file, start]:
                if now is not None:
                    yield flush()
                first = lines[0].as_py()
                # of a split that begins inside quotes, a line begins a record after an odd number of them
                now = [file, start, False, False, bool(first.endswith("\r"))]
            before = (np.cumsum(quotes) - quotes + now[2]) % 2
            now[3] = now[3] or bool(before.any())
            now[2] = bool((quotes.sum() + now[2]) % 2)
        if now is not None:
            yield flush()

    return run


def _assembled(inside, returns):
    """Records of each split. ``inside``: for a split that begins inside quotes, the split its first lines belong to;
    ``returns``: the files whose lines end in a carriage return and a break."""
    splits = _by_split()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        schema = pa.schema(
            [("file", pa.string()), ("start", pa.int64()), ("owner", pa.int64()), ("first", pa.bool_()), ("whole", pa.bool_()), ("record", pa.string())]
        )

        def rows(split, records, first, whole, owner=None):
            file, start = split
            n = len(records)
            columns = [[file] * n, [start] * n, [start if owner is None else owner] * n, first, whole, records]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema, strict=True)], schema=schema)

        split, parity, held, fresh, head = None, 0, [], True, False

        def last():
            """What is held when a split ends: a record that ends here, or a piece of one that goes on."""
            text = pa.array(["\n".join(held)], pa.string())
            owner = inside.value[split] if head else None
            return rows(split, text, [fresh and split[1] == 0], [not head and parity == 0], owner)

        for file, start, lines, quotes in splits(batches):
            if split != (file, start):
                if held:
                    yield last()
                split, held, fresh = (file, start), [], True
                head = split in inside.value
                parity = int(head)
            if file in returns.value:
                lines = pc.if_else(pc.ends_with(lines, "\r"), pc.utf8_slice_codeunits(lines, 0, -1), lines)
            before = (np.cumsum(quotes) - quotes + parity) % 2
            parity = int((quotes.sum() + parity) % 2)
            begins = np.flatnonzero(before == 0)
            if not len(begins):
                held += lines.to_pylist()
                continue
            if held or begins[0]:
                held += lines.slice(0, begins[0]).to_pylist()
                text = pa.array(["\n".join(held)], pa.string())
                yield rows(split, text, [fresh and split[1] == 0], [not head], inside.value[split] if head else None)
                fresh, head = fresh and head, False
            done = begins[:-1]
            if len(done):
                part = lines.slice(begins[0], begins[-1] - begins[0])
                lists = pa.ListArray.from_arrays(pa.array((begins - begins[0]).astype(np.int32)), part)
                first = np.zeros(len(done), bool)
                first[0] = fresh and split[1] == 0
                yield rows(split, pc.binary_join(lists, "\n"), first, np.ones(len(done), bool))
                fresh = False
            held = lines.slice(begins[-1]).to_pylist()
        if held:
            yield last()

    return run


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, record): the records of all CSV files under a path; ``first`` marks the first of each file.

    Fields are quoted by double quotes, a quote inside a field is doubled, and no other field holds one. A file
    with an odd number of quotes is an error. Carriage returns before breaks are dropped in files whose first
    line ends in one. Empty lines are no records. The driver holds a number for each split that begins inside
    quotes, and one for each file with carriage returns.
    """
    lines = _lines(spark, path)
    splits = lines.mapInArrow(_summaries(), _SUMMARY)
    in_file = W.partitionBy("file").orderBy("start")
    earlier = in_file.rowsBetween(W.unboundedPreceding, -1)
    odd = F.sum(F.col("odd").cast("int"))
    standing = splits.withColumn("before", F.coalesce(odd.over(earlier), F.lit(0)) % 2)
    begins = (F.col("before") == 0) | F.col("begins_if_odd")
    standing = standing.withColumn("owner", F.last(F.when(begins, F.col("start")), True).over(earlier))
    whole = W.partitionBy("file")
    standing = standing.withColumn("unclosed", odd.over(whole) % 2 == 1)
    wanted = standing.where((F.col("before") == 1) | (F.col("ends_in_return") & (F.col("start") == 0)) | F.col("unclosed"))
    inside, returns = {}, set()
    for r in wanted.collect():
        if r["unclosed"]:
            raise ValueError(f"{r['file']} has an odd number of quotes")
        if r["before"]:
            inside[r["file"], r["start"]] = r["owner"]
        if r["ends_in_return"] and r["start"] == 0:
            returns.add(r["file"])
    share = spark.sparkContext.broadcast
    pieces = lines.mapInArrow(_assembled(share(inside), share(returns)), _PIECES)
    if not inside:
        return pieces.where("record <> ''").select("file", "first", "record")
    joined = (
        pieces.where("NOT whole")
        .groupBy("file", "owner")
        .agg(F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("start", "record"))).alias("parts"))
        .select("file", "first", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    )
    return pieces.where("whole AND record <> ''").select("file", "first", "record").unionByName(joined)


def parsed(rows: DataFrame, names: list[str], options: dict[str, str]) -> DataFrame:
    """The fields of records as text columns, without each file's first record, which must hold ``names``."""
    schema = ", ".join(f"`c{i}` STRING" for i in range(len(names)))
    row: Column = F.from_csv("record", F.lit(schema), options)
    fields = rows.withColumn("fields", row)
    same = F.lit(True)
    for i, name in enumerate(names):
        same = same & F.col(f"fields.c{i}").eqNullSafe(F.lit(name))
    other = F.raise_error(F.concat(F.lit("the header of "), F.col("file"), F.lit(" differs from that of the others")))
    data = fields.where(F.when(~F.col("first"), True).when(same, False).otherwise(other.cast("boolean")))
    return data.select(*[F.col(f"fields.c{i}").alias(name) for i, name in enumerate(names)])
