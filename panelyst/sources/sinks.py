"""Saving named results and exporting report tables."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors can reach.

    Where that is unset, as in tests, it lies under the warehouse folder of the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/staged"
    return f"{root.rstrip('/')}/panelyst-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage of a table that several reports read, and survives the loss
    of executors.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save_tables(tables: Mapping[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """Save named results as Parquet, one folder each."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def export_csv(df: DataFrame, path: str, single_file: bool = False, mode: str = "errorifexists") -> None:
    """Export a table as CSV with a header, NULL as an empty field, quotes doubled, blanks and line breaks kept.

    ``single_file`` is for finished report tables, whose size depends on levels and
    groups only; the work before it stays spread out.
    """
    out = df.repartition(1) if single_file else df
    writer = out.write.mode(mode).option("header", True).option("emptyValue", "").option("quote", '"').option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def export_report(tables: Mapping[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """One single-file CSV per report sheet."""
    for name, df in tables.items():
        export_csv(df, f"{folder}/{name}", single_file=True, mode=mode)
