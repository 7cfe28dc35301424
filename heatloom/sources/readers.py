"""Readers: meter readings, locale CSV, matrix lines, holiday tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatloom.functions.order import sorted_offset
from heatloom.schema import READING


def scan_readings(spark: SparkSession, path: str, source: str, fmt: str = "csv") -> DataFrame:
    """Readings of one source: the reading columns by name, typed, plus the source as a literal column."""
    raw = spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.format(fmt).load(path)
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in READING.fields if f.name != "source"]
    return raw.select(*typed, F.lit(source).alias("source"))


def union_sources(dfs: list[DataFrame]) -> DataFrame:
    """Rows of all sources under one schema."""
    return reduce(DataFrame.unionByName, dfs)


def union_diagonal(dfs: list[DataFrame]) -> DataFrame:
    """Union by column name; a column a frame lacks is null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def build_holidays(intervals: DataFrame, single_days: DataFrame, fmt: str = "dd.MM.yyyy") -> DataFrame:
    """School-holiday intervals and one-day public holidays (end null) as ``state, start, end, type``.

    ``start`` is an ISO date; ``end`` is parsed with ``fmt`` and becomes null where that fails.
    """
    end = F.try_to_timestamp(F.col("end").cast("string"), F.lit(fmt)).cast("date").alias("end")
    cols = ["state", F.col("start").cast("date").alias("start"), end, "type"]
    return intervals.select(*cols).unionByName(single_days.select(*cols))


def parse_dates(
    df: DataFrame, cols: list[str], fmt: str | None = None, strict: bool = True, kind: str = "timestamp"
) -> DataFrame:
    """Parse text columns; strict parsing fails on bad text, otherwise it becomes null."""
    args = [F.lit(fmt)] if fmt else []

    def parsed(c: str) -> Column:
        if strict:
            return F.to_timestamp(F.col(c), fmt) if fmt else F.to_timestamp(F.col(c))
        return F.try_to_timestamp(F.col(c), *args)

    return df.withColumns({c: parsed(c).cast(kind) for c in cols})


def decimal_comma(df: DataFrame, schema: T.StructType, decimal: str = ",") -> DataFrame:
    """Cast text columns to ``schema``; numbers use ``decimal`` as their decimal sign."""

    def typed(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FractionalType, T.IntegralType)) and decimal != ".":
            c = F.regexp_replace(c, F.lit(decimal), F.lit("."))
        return c.cast(f.dataType).alias(f.name)

    return df.select(*[typed(f) for f in schema.fields])


def scan_locale_csv(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = ";", decimal: str = ","
) -> DataFrame:
    """CSV with a field separator and decimal sign other than the defaults."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    return decimal_comma(raw, schema, decimal)


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their zero-based number (files in name order)."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("line"),
    )
    numbered = sorted_offset(lines, ["_file", "_block", "_at"], F.lit(1).cast("long"), "line_no")
    return numbered.select("line_no", "line")


def parse_matrix_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``[a b;c d]`` lines to one row per value with zero-based ``row`` and ``slot`` positions."""
    text = F.trim(F.regexp_replace(line, r"[\[\]]", ""))
    keep = [c for c in lines.columns if c != line]
    rows = lines.select(*keep, F.posexplode(F.split(text, ";")).alias("row", "_cells"))
    cells = F.split(F.trim(F.col("_cells")), r"\s+")
    return rows.select(*keep, "row", F.posexplode(cells).alias("slot", "_value")).select(
        *keep, "row", "slot", F.col("_value").cast("double").alias("value")
    )


def parse_list_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``[1 2 3]`` lines to one row per number with its zero-based ``position``."""
    text = F.trim(F.regexp_replace(line, r"[\[\]]", ""))
    keep = [c for c in lines.columns if c != line]
    return lines.select(*keep, F.posexplode(F.split(text, r"\s+")).alias("position", "_value")).select(
        *keep, "position", F.col("_value").cast("long").alias("value")
    )


def cast_schema(df: DataFrame, types: dict[str, str], timestamps: list[str] = ()) -> DataFrame:
    """Cast the named columns, parse ``timestamps`` from text, leave the others."""
    return df.withColumns(
        {**{c: F.col(c).cast(t) for c, t in types.items()}, **{c: F.to_timestamp(F.col(c)) for c in timestamps}}
    )


def count_sensors(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Number of rows and of distinct series."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(id_col).alias("n_sensors"))
