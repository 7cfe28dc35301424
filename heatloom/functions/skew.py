"""Joins of many rows to few, safe when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StructType, TimestampNTZType, TimestampType

SALTS = 16
#: Most bytes of rows and hash table that a broadcast may take, also where ``spark.sql.autoBroadcastJoinThreshold`` allows more: the driver
#: holds them several times, collected, hashed and written out.
MOST = 10 << 20
#: Times that rows in memory may be larger than the files Spark goes by.
UNPACKED = 64
#: Types that take one word of a row.
FIXED = (BooleanType, DateType, NumericType, TimestampNTZType, TimestampType)


def estimated_bytes(df: DataFrame) -> int | None:
    """Size the optimizer assumes for ``df``; None where the session does not tell."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:  # noqa: BLE001 - a remote session has no plan to look at
        return None


def broadcast_limit(df: DataFrame) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes."""
    text = str(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")).lower()
    text = text.removesuffix("b") if not text.lstrip("-").isdigit() else text
    units = {"k": 10, "m": 20, "g": 30}
    return int(text[:-1]) << units[text[-1]] if text[-1] in units else int(text)


def seems_small(df: DataFrame) -> bool:
    """Whether Spark broadcasts ``df`` in a join by itself."""
    size = estimated_bytes(df)
    return size is not None and size <= broadcast_limit(df)


def row_bytes(schema: StructType) -> int:
    """Bytes of a row in a hash table: two words for each column, six for a text or a nested value, eight for places and the key's copy."""
    return 64 + sum(16 if isinstance(f.dataType, FIXED) else 48 for f in schema)


def is_small(df: DataFrame) -> bool:
    """Whether Spark broadcasts ``df`` in a join by itself and its rows are few enough for that.

    Spark goes by the bytes of the files, which are compressed: a table of a few MB can have a million rows, which the driver would
    collect and hash. So rows are counted where the files look small.
    """
    return seems_small(df) and df.count() * row_bytes(df.schema) <= min(broadcast_limit(df), MOST)


def is_tiny(df: DataFrame) -> bool:
    """Whether the rows of ``df`` are few enough for a broadcast however well its files are packed."""
    size = estimated_bytes(df)
    return size is not None and size * UNPACKED <= min(broadcast_limit(df), MOST)


def may_be_broadcast(df: DataFrame) -> bool:
    """Whether Spark may broadcast ``df`` whatever the number of its rows; so too where it does not tell their size."""
    return estimated_bytes(df) is None or seems_small(df) or broadcast_limit(df) > MOST


def shuffled_join(rows: DataFrame, dim: DataFrame, on: list[str], how: str) -> DataFrame:
    """The join for a ``dim`` of many rows: neither side is broadcast because its files look small."""
    looks = may_be_broadcast(dim) or (how == "inner" and may_be_broadcast(rows))
    return rows.join(dim.hint("merge") if looks else dim, on, how)


def spread_join(
    rows: DataFrame,
    dim: DataFrame,
    on: list[str] | str,
    how: str = "left",
    by: list[str] | str = "datetime",
    salts: int = SALTS,
) -> DataFrame:
    """Join ``dim`` (few rows per key) to ``rows`` (any number of rows per key).

    A ``dim`` whose files and rows are below the broadcast threshold (``is_small``) is joined as it is. Otherwise each key, also a
    null one, is spread over ``salts`` shuffle partitions by a hash of ``by`` (columns that vary within a key) and
    ``dim`` is copied to each of them; adaptive execution splits what is still too large. The salt is part of the
    join key, so a later window can not take over a partitioning by the bare key, which would put a hot key back
    into one task.
    """
    on = [on] if isinstance(on, str) else list(on)
    by = [by] if isinstance(by, str) else list(by)
    if is_small(dim):
        return rows.join(dim, on, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return shuffled_join(salted, copies, [*on, "_salt"], how).drop("_salt")
