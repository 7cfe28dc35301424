"""Rows of stored documents, told apart by their place."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.functions.tables import materialize

#: Names of a row's place: a hash of its file's path, its number in the file.
PLACE = ["file", "at"]


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` if it is read straight from Parquet files, whose rows have a place; else a stored copy of it."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return docs
    except AnalysisException:
        return materialize(docs)


def placed(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``), ``file``, ``at``; equal rows have places of their own."""
    stored = scan(docs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return stored.select(row, F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
