"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.views import SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def presented(df: DataFrame) -> DataFrame:
    """Doubles with six digits, time stamps without zone, so that both engines show the same values."""
    cols = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols[f.name] = F.round(F.col(f"`{f.name}`").cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            cols[f.name] = F.col(f"`{f.name}`").cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            cols[f.name] = F.col(f"`{f.name}`").cast("bigint")
    return df.withColumns(cols) if cols else df


def ordered_views(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(name: str) -> None:
        if name not in out:
            for need in SQL[name][0]:
                visit(need)
            out.append(name)

    for n in names:
        visit(n)
    return out


def query(name: str, sql: str | None = None, needs: str = "", floats: str = "", ints: str = ""):
    """Register a query; ``needs`` are the views its SQL uses, ``floats`` / ``ints`` the columns to bring in form."""

    def register(make: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: presented(make(Views(spark, sf_dir)))
        if sql is not None:
            views = ordered_views(needs.split())
            head = "WITH " + ",\n".join(f"{v} AS ({SQL[v][1]})" for v in views) + "\n" if views else ""
            form = [f'round("{c}", 6) + 0.0 AS "{c}"' for c in floats.split()]
            form += [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in ints.split()]
            body = f"SELECT * REPLACE ({', '.join(form)}) FROM ({sql}) AS _q" if form else sql
            ORACLES[name] = head + body
        return make

    return register
