"""Rows known by their file and place in it, so that what is found about them need not move their texts.

A scan of Parquet files tells the file and the place of every row. Findings about rows are written to the
shared folder, one folder for each file of the scan and range of its rows; a task that scans a file again reads
what belongs to the rows at hand. So neither writing nor reading takes a whole file into one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyst.sources.sinks import shared_folder

#: Rows of a file whose findings are written, and read again, together.
RANGE = 1 << 16


def file_system(path: str):
    """The file system of a path or URI and the path in it."""
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = path[len("file:") :]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def located(docs: DataFrame, columns: Sequence[Column], scan: bool) -> DataFrame:
    """``columns`` of ``docs``, and ``file`` and ``row``: a number of the file and the place in it.

    ``scan`` says that ``docs`` is a table just read from Parquet files, with nothing done to it; those files are
    then scanned where they are. Else the columns are written to the shared folder first.
    """
    place = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    if scan:
        return docs.select(*columns, *place)
    path = f"{shared_folder(docs.sparkSession)}/rows"
    docs.select(*columns).write.parquet(path)
    return docs.sparkSession.read.parquet(path).select("*", *place)


def by_file(rows: DataFrame, name: str) -> str:
    """Write rows into one folder for each ``file`` and range of rows, in the order of their ``row``; returns the folder."""
    path = f"{shared_folder(rows.sparkSession)}/{name}"
    ranged = rows.withColumn("range", F.floor(F.col("row") / RANGE)).repartition("file", "range")
    ranged.sortWithinPartitions("file", "range", "row").write.partitionBy("file", "range").parquet(path)
    return path


def read_range(path: str, file: int, number: int, columns: list[str]) -> dict[str, np.ndarray]:
    """What ``by_file`` has written for a range of a file, ordered by row; empty where it has nothing."""
    from pyarrow import fs

    system, inner = file_system(path)
    parts = system.get_file_info(fs.FileSelector(f"{inner}/file={file}/range={number}", allow_not_found=True))
    tables = []
    for part in parts:
        if part.path.endswith(".parquet"):
            with system.open_input_file(part.path) as f:
                tables.append(pq.ParquetFile(f).read(columns=columns))
    if not tables:
        return {}
    table = pa.concat_tables(tables)
    order = np.argsort(table["row"].to_numpy(), kind="stable")
    return {c: table[c].to_numpy()[order] for c in columns}


def scan_with(texts: DataFrame, path: str, columns: list[str], each: Callable, schema) -> DataFrame:
    """``each(batch, rows of the side table, where those of each text begin and end)`` over all batches of a scan."""
    span = RANGE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], dict[str, np.ndarray]] = {}
        for batch in batches:
            place = np.stack([batch.column("file").to_numpy(), batch.column("row").to_numpy() // span])
            cuts = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                at = (int(place[0, a]), int(place[1, a]))
                if at not in held:
                    held = {at: read_range(path, *at, columns)}
                side = held[at]
                part = batch.slice(a, b - a)
                rows = part.column("row").to_numpy()
                own = side.get("row", np.empty(0, np.int64))
                yield from each(part, side, np.searchsorted(own, rows), np.searchsorted(own, rows, side="right"))

    return texts.mapInArrow(run, schema)
