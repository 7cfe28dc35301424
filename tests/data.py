"""Fixture builders and brute-force references."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

START = datetime(2024, 1, 1)
SCHEMA = "id string, datetime timestamp_ntz, diff double, value double, source string"


def at(day: int, hour: int = 0) -> datetime:
    return START + timedelta(days=day, hours=hour)


def frame(spark, rows, schema=SCHEMA):
    """Rows of (id, day, diff, value) with source filled in."""
    full = [(i, at(d), None if x is None else float(x), None if v is None else float(v), "s") for i, d, x, v in rows]
    return spark.createDataFrame(full, schema)


def series(spark, **by_id):
    """``a=[(day, diff), ...]``; the counter is the day number times ten."""
    return frame(spark, [(i, d, x, 10 * d) for i, points in by_id.items() for d, x in points])


def random_series(spark, ids: int = 40, days: int = 60, seed: int = 1, hot: int = 0, null: float = 0.1):
    """Irregular series with gaps, zeros and nulls; the first has ``hot`` days, about a third of all rows if asked so."""
    rnd = random.Random(seed)
    rows = []
    for i in range(ids):
        last = hot if hot and i == 0 else rnd.randint(1, days)
        total = 0.0
        for d in range(last):
            if d not in (0, last - 1) and rnd.random() < 0.25:
                continue
            x = rnd.choice([0.0, 0.0, float(rnd.randint(1, 30)), round(rnd.random() * 100, 2)])
            total += x
            rows.append((f"s{i}", d, None if rnd.random() < null else x, None if rnd.random() < null else total))
    return frame(spark, rows)


def rows_of(df, *cols):
    """Sorted plain tuples, doubles with nine digits."""
    cols = cols or df.columns

    def plain(x):
        return round(x, 9) + 0.0 if isinstance(x, float) else x

    return sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def by_series(df) -> dict:
    """Brute-force input: the rows of each series in time order."""
    out: dict = {}
    for r in df.orderBy("id", "datetime").collect():
        out.setdefault(r["id"], []).append(r)
    return out


def day_of(col="datetime"):
    return F.datediff(col, F.lit("2024-01-01")).alias("day")
