"""Scans. Ids are read as text unless a schema says otherwise."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from panelyst.operators.clean import na_strings
from panelyst.operators.codebook import metadata_labels, with_labels
from panelyst.sources import multiline as M

# The texts that mean "missing" in a survey file.
NA_TOKENS = ("", "NA")


_QUOTES = {"quote": '"', "escape": '"'}


def _reader(spark: SparkSession) -> DataFrameReader:
    """Fields in double quotes, a quote inside one doubled."""
    return spark.read.option("header", True).options(**_QUOTES)


def _texts(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    """All fields as text. ``multiline`` lets quoted fields hold line breaks; files are split either way."""
    names = _reader(spark).option("multiLine", multiline).csv(path).columns
    if multiline:
        return M.parsed(M.records(spark, path), names, _QUOTES)
    text = StructType([StructField(n, StringType()) for n in names])
    return _reader(spark).option("enforceSchema", False).schema(text).csv(path)


def find_files(spark: SparkSession, folder: str, pattern: str, suffix: str = ".csv") -> list[str]:
    """The file sets of a folder whose names match a regular expression, in order.

    A set is a file ``name.csv`` or a folder of such files; its name is the file's without the suffix or the
    folder's. Only paths are read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
    base = F.regexp_replace("path", r"/+$", "")
    parent = F.regexp_extract(base, r"^(.*)/[^/]+$", 1)
    is_part = F.regexp_extract(base, r"([^/]+)$", 1).startswith("part-")
    sets = found.load(folder).select(F.when(is_part, parent).otherwise(base).alias("path")).distinct()
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), f"{re.escape(suffix)}$", "")
    return sorted(r["path"] for r in sets.where(name.rlike(pattern)).collect())


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: StructType | str | None = None,
    na: Sequence[str] = NA_TOKENS,
    multiline: bool = False,
) -> DataFrame:
    """CSV with a header, columns by name. Of several paths each may have an order of columns of its own.

    All fields are read as text, blanked where they are a missing-value token, and
    then cast to ``schema``. A field that is no such value fails the job rather
    than turning into NULL unseen, and so does a file whose header differs from that of the others
    under its path. Without a schema every column stays text, which saves the extra scan that type
    inference needs.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    parts = []
    for one in [path] if isinstance(path, str) else path:
        raw = na_strings(_texts(spark, one, multiline), na)
        if schema is not None:
            missing = [f.name for f in schema.fields if f.name not in raw.columns]
            if missing:
                raise ValueError(f"{one} has no columns {missing}")
            raw = raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        parts.append(raw)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=schema is None), parts)


#: What a text can be read as, the narrowest type first, each with the pattern of its texts.
_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|NaN|[+-]?Infinity"
_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
_KINDS = {
    "int": "[+-]?[0-9]+",
    "bigint": "[+-]?[0-9]+",
    "double": _NUMBER,
    "date": _DAY,
    "timestamp": _DAY + r"([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?",
    "boolean": "(?i)true|false",
}


def _readings(c: str) -> Column:
    """The types a text can be read as, one bit each; NULL for NULL."""
    out = F.lit(0)
    for bit, (kind, pattern) in enumerate(_KINDS.items()):
        fits = F.col(c).rlike(f"^({pattern})$") & F.col(c).try_cast(kind).isNotNull()
        out = out + F.when(fits, 1 << bit).otherwise(0)
    return F.when(F.col(c).isNotNull(), out)


def inferred_types(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """The narrowest type that all texts of each column can be read as, from one scan.

    Types form a lattice: int, bigint and double widen in this order, date widens to timestamp, and all else meets
    in string. A row leaves the types its text can have and rows are folded by AND, in any order and across
    files. A column without a value is a string.
    """
    if not cols:
        return {}
    left = df.agg(*[F.bit_and(_readings(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        able = [kind for bit, kind in enumerate(_KINDS) if (left[f"m{i}"] or 0) >> bit & 1]
        out[c] = able[0] if able else "string"
    return out


def read_csv_inferred(
    spark: SparkSession, path: str | Sequence[str], text_cols: Iterable[str] = (), multiline: bool = False
) -> DataFrame:
    """CSV with inferred types; columns named in ``text_cols`` are kept as text.

    One more scan of all paths together finds the types, see :func:`inferred_types`. Leading zeros of ids survive
    only for the text columns. Columns go by name as in :func:`read_csv`; a column that a path lacks is NULL there.
    """
    keep = set(text_cols)
    paths = [path] if isinstance(path, str) else path
    parts = [na_strings(_texts(spark, one, multiline), NA_TOKENS[1:]) for one in paths]
    texts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    types = inferred_types(texts, [c for c in texts.columns if c not in keep])
    return texts.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in texts.columns])


def read_lookup(spark: SparkSession, path: str, names: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """Headerless lookup sheet with the given column names, all text."""
    schema = StructType([StructField(n, StringType()) for n in names])
    return _reader(spark).option("header", False).schema(schema).csv(path).drop(*drop)


def read_lookups(spark: SparkSession, folder: str, sheets: Sequence[str]) -> dict[str, DataFrame]:
    """One table per sheet; ``folder/<sheet>`` holds the sheet as CSV with a header."""
    return {s: read_csv(spark, f"{folder}/{s}") for s in sheets}


def read_labelled(spark: SparkSession, path: str, labels: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Parquet data set and its codebook ``(variable, description)``.

    Labels come from the column metadata that Spark stores with the file; a given
    mapping is added to it.
    """
    df = spark.read.parquet(path)
    if labels:
        df = with_labels(df, labels)
    return df, metadata_labels(df)


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Small table written out in code."""
    return spark.createDataFrame(list(rows), schema)
