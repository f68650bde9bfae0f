"""WARC archives of web pages: written as whole-file gzip streams, then normalised.

A crawler often leaves one gzip stream around a whole file of records, which can only be read from its start.
The normaliser inflates such a stream once, writes every record as its own gzip member, and beside the archive
an index of where each member lies, so that a reader may seek.

Spark's text writer makes the first form (rows are records, and its line end closes the record). The archives
lie in a folder that all machines share; tasks open it through ``pyarrow.fs``. A task writes under a name of
its own attempt and renames when it is done, so that a lost or repeated task leaves whole files only.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyst.llm.places import by_file, file_system, located, scan_with
from panelyst.sources.sinks import materialise

BLOCK = 1 << 20
INDEX = "archive string, offset long, length long, record_id string, record_type string"
PAGES = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
)


def _payload() -> dict[str, Column]:
    return {
        "payload_bytes": F.octet_length("html").cast("long"),
        "payload_digest": F.sha2(F.col("html").cast("binary"), 256),
    }


def repeats(pages: DataFrame, least: int = 100) -> DataFrame:
    """(file, row, first_id) of the ``pages`` (page_id, html, file, row) that repeat the payload of another.

    Of equal payloads of at least ``least`` bytes the smallest id is the first. Only ids, digests and places are
    shuffled, and they are written before they are joined, so that Spark can split a payload that very many pages share.
    """
    sized = pages.withColumns(_payload()).where(F.col("payload_bytes") >= least)
    sized = materialise(sized.select("page_id", "payload_digest", "file", "row"), "digests")
    firsts = (
        sized.groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("first_id").isNotNull())
        .drop("n")
    )
    found = sized.join(materialise(firsts, "firsts"), "payload_digest")
    return found.where(~F.col("page_id").eqNullSafe(F.col("first_id"))).select("file", "row", "first_id")


def decide(pages: DataFrame, least: int = 100) -> DataFrame:
    """``pages`` (page_id, url, html, file, row) with payload_bytes, payload_digest and first_id, NULL but for repeats.

    What repeats is found by digest and brought to the pages by their places, as these are scanned again: no
    payload is shuffled.
    """
    path = by_file(repeats(pages, least), "repeats")

    def each(part: pa.RecordBatch, side: dict[str, np.ndarray], begin: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = end > begin
        first = np.zeros(len(part), np.int64)
        if own.any():
            first[own] = side["first_id"][begin[own]]
        columns = [part.column(c) for c in ("page_id", "url", "html")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(first, mask=~own)], ["page_id", "url", "html", "first_id"])

    schema = "page_id long, url string, html string, first_id long"
    return scan_with(pages, path, ["row", "first_id"], each, schema).withColumns(_payload())


def _record(html: Column) -> Column:
    """The text of a record without its last line end."""
    revisit = F.col("first_id").isNotNull()
    clean_url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), clean_url)),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first_id").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), F.when(revisit, "").otherwise(html), F.lit("\r\n\r"))


def write_monolithic(pages: DataFrame, folder: str) -> None:
    """Write ``pages`` (page_id, url, html, as ``decide`` returns them) as one gzip stream a partition."""
    pages.select(_record(F.col("html")).alias("value")).write.option("compression", "gzip").option("lineSep", "\n").text(folder)


class Inflated:
    """Reads gzip members one after another from a stream as one stream of bytes."""

    def __init__(self, raw):
        self.raw, self.z, self.buffer = raw, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        left = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        block = left or self.raw.read(BLOCK)
        if not block:
            if not self.z.eof and self.buffer:
                raise ValueError("the archive ends inside a gzip stream")
            return False
        if self.z.eof:
            self.z = zlib.decompressobj(31)
        self.buffer += self.z.decompress(block, BLOCK)
        return True

    def line(self) -> bytes | None:
        while (at := self.buffer.find(b"\n")) < 0:
            if not self._more():
                return None
        out = bytes(self.buffer[: at + 1])
        del self.buffer[: at + 1]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def records(raw) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, payload, the whole record) of every record of a gzip stream, in order."""
    stream = Inflated(raw)
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head, headers = [line], {}
        while (line := stream.line()) is not None and line.strip():
            head.append(line)
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip()] = value.strip()
        payload = stream.take(int(headers["Content-Length"]))
        end = stream.take(4)
        yield headers, payload, b"".join(head) + b"\r\n" + payload + end


def _urn(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def normalise(spark: SparkSession, folder: str, target: str, tasks: int | None = None, level: int = 4) -> DataFrame:
    """Rewrite each archive of ``folder`` with a gzip member for each record, and an index beside it.

    ``target`` gets ``<name>.warc.gz`` and ``<name>.idx`` (a JSON line for each record: offset, length, id,
    type). Returns one row for each archive; a task holds one record at a time.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(folder).select("path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, out = file_system(target)
        system.create_dir(out, recursive=True)
        for batch in batches:
            for path in batch["path"]:
                source, inner = file_system(path)
                name = inner.rsplit("/", 1)[-1].removesuffix(".txt.gz")
                own = f"{out}/.{name}-{uuid.uuid4().hex}"
                n = offset = 0
                with (
                    source.open_input_stream(inner, compression=None) as raw,
                    system.open_output_stream(f"{own}.warc.gz", compression=None) as archive,
                    system.open_output_stream(f"{own}.idx") as index,
                ):
                    for headers, _, whole in records(raw):
                        z = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = z.compress(whole) + z.flush()
                        archive.write(member)
                        entry = {
                            "archive": f"{name}.warc.gz",
                            "offset": offset,
                            "length": len(member),
                            "record_id": headers["WARC-Record-ID"],
                            "record_type": headers["WARC-Type"],
                        }
                        index.write(json.dumps(entry).encode() + b"\n")
                        offset += len(member)
                        n += 1
                for end in (".warc.gz", ".idx"):
                    system.move(f"{own}{end}", f"{out}/{name}{end}")
                yield pd.DataFrame({"archive": [f"{name}.warc.gz"], "records": [n], "bytes": [offset]})

    wide = files.repartition(tasks or max(files.rdd.getNumPartitions(), 1), "path")
    return wide.mapInPandas(run, "archive string, records long, bytes long")


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """All entries of the sidecar indexes: archive, offset, length, record_id, record_type."""
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.idx").json(target)


def read_archives(spark: SparkSession, target: str) -> DataFrame:
    """Read every record back by its index entry: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    The digest of a response is computed from its payload and must agree with its header; a revisit has no
    payload of its own and reports length and digest of the one it refers to.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, out = file_system(target)
        for batch in batches:
            rows = []
            for archive, part in batch.groupby("archive"):
                with system.open_input_file(f"{out}/{archive}") as f:
                    for offset, length in zip(part["offset"], part["length"], strict=True):
                        f.seek(offset)
                        whole = zlib.decompress(f.read(length), 31)
                        head, _, rest = whole.partition(b"\r\n\r\n")
                        headers = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:] if ": " in x)
                        payload = rest[: int(headers["Content-Length"])]
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        revisit = headers["WARC-Type"] == "revisit"
                        if not revisit and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
                        rows.append(
                            (
                                _urn(headers["WARC-Record-ID"]),
                                headers.get("WARC-Target-URI"),
                                int(headers["X-Payload-Length"]) if revisit else len(payload),
                                digest,
                                headers["WARC-Type"],
                                _urn(headers.get("WARC-Refers-To")),
                            )
                        )
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES.split(", ")]).astype(
                {"page_id": "Int64", "refers_to": "Int64"}
            )

    return read_index(spark, target).mapInPandas(run, PAGES)


def round_trip(pages: DataFrame, folder: str, id_col: str = "page_id", scan: bool = False) -> DataFrame:
    """Write pages to archives under ``folder``, normalise those, and read them back: one row for each page.

    ``scan`` says that ``pages`` is a table just read from Parquet files, with nothing done to it; those files are
    then scanned twice, where else a copy of the pages is.

    A NULL html is an empty payload and a NULL url has no header; a page without an id gets an empty record id
    and can be a revisit, never the first. Rows that repeat with their id are all responses of that id. Other
    columns are not looked at. An empty table gives an empty result.
    """
    spark = pages.sparkSession
    columns = [
        F.col(id_col).cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ]
    rows = located(pages, columns, scan)
    write_monolithic(decide(rows), f"{folder}/monolithic")
    n_files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt.gz").load(f"{folder}/monolithic").count()
    if not n_files:
        return spark.createDataFrame([], PAGES)
    normalise(spark, f"{folder}/monolithic", f"{folder}/members", tasks=n_files).write.mode("overwrite").parquet(f"{folder}/log")
    return read_archives(spark, f"{folder}/members")
