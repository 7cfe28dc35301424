"""Cleaning and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import D, H
from heatloom import Series
from heatloom.functions.tables import new_path
from heatloom.operators import cleaning
from heatloom.plans import cleaning as chains
from heatloom.sources import incremental

COLS = "id, datetime, diff, value, source"
W = "WINDOW w AS (PARTITION BY id ORDER BY datetime)"


@query("counter_to_diff", f"SELECT id, datetime, value, source, value - lag(value) OVER w AS diff FROM readings {W}", "readings", "diff value")
def _(v):
    return cleaning.counter_to_diff(v.readings, D)


@query(
    "drop_leading_zeros",
    """SELECT id, datetime, d AS diff, value, source FROM (
      SELECT *, min(CASE WHEN d > 0 THEN datetime END) OVER (PARTITION BY id) AS s
      FROM (SELECT *, CASE WHEN day(datetime) < 5 THEN 0.0 ELSE diff END AS d FROM readings))
    WHERE datetime >= s AND value <> d""",
    "readings",
    "diff value",
)
def _(v):
    df = v.readings.withColumn("diff", F.when(F.dayofmonth("datetime") < 5, 0.0).otherwise(F.col("diff")))
    return cleaning.drop_leading_zeros(df, D)


def _reconnect(source: str, unit: str, limit: int) -> str:
    return f"""SELECT {COLS} FROM (SELECT *, lag(datetime) OVER w AS p FROM {source} {W})
    WHERE p IS NULL OR date_diff('{unit}', p, datetime) - 1 < {limit}"""


@query("drop_reconnect_spikes", _reconnect("dirty", "day", 1), "dirty", "diff value")
def _(v):
    return cleaning.drop_reconnect_spikes(v.dirty, D)


USER_HOURS = """SELECT CAST(user_id AS VARCHAR) AS id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS datetime,
    round(sum(value), 2) AS diff, CAST(0 AS DOUBLE) AS value, 's' AS source FROM events GROUP BY 1, 2"""


def user_hours(v):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return v.table("events").groupBy(F.col("user_id").cast("string").alias("id"), hour.alias("datetime")).agg(
        F.round(F.sum("value"), 2).alias("diff"), F.lit(0.0).alias("value"), F.lit("s").alias("source")
    )


@query("drop_reconnect_spikes_hourly", _reconnect(f"({USER_HOURS})", "hour", 3), "", "diff value")
def _(v):
    return cleaning.drop_reconnect_spikes(user_hours(v), H)


def _bounds(source: str) -> str:
    rank = "floor((n - 1) * CAST({} AS DOUBLE) + 0.5) + 1"
    return f"""SELECT id, max(CASE WHEN k = {rank.format(0.25)} THEN diff END) AS q25, max(CASE WHEN k = {rank.format(0.75)} THEN diff END) AS q75
    FROM (SELECT id, diff, row_number() OVER (PARTITION BY id ORDER BY diff) AS k, count(*) OVER (PARTITION BY id) AS n
          FROM {source} WHERE diff IS NOT NULL) GROUP BY id"""


@query(
    "iqr_filter",
    f"SELECT d.id, datetime, diff, value, source FROM dirty d JOIN ({_bounds('dirty')}) b ON d.id = b.id WHERE diff <= q75 + 1.5 * (q75 - q25)",
    "dirty",
    "diff value",
)
def _(v):
    return cleaning.iqr_filter(v.dirty, D)


_FLAGGED = f"""SELECT d.id, datetime, diff, diff > q75 + 1.5 * (q75 - q25) OR diff < q25 - 1.5 * (q75 - q25) AS outlier
    FROM dirty d JOIN ({_bounds('dirty')}) b ON d.id = b.id"""


@query("iqr_flag", _FLAGGED, "dirty", "diff")
def _(v):
    return cleaning.iqr_flag(v.dirty.select("id", "datetime", "diff"), D)


@query(
    "outlier_share",
    f"SELECT count(*) FILTER (outlier) AS n_outliers, count(*) FILTER (outlier) / count(*) * 100 AS pct_outliers FROM ({_FLAGGED})",
    "dirty",
    "pct_outliers",
)
def _(v):
    return cleaning.outlier_share(cleaning.iqr_flag(v.dirty, D))


def _flat(source: str, limit: int) -> str:
    return f"""SELECT {COLS} FROM (
      SELECT *, row_number() OVER (PARTITION BY id, run ORDER BY datetime) AS k, count(*) OVER (PARTITION BY id, run) AS n
      FROM (SELECT *, sum(CASE WHEN diff <> 0 THEN 1 ELSE 0 END) OVER w AS run FROM {source} WHERE diff IS NOT NULL {W}))
    WHERE k = 1 OR n - 1 <= {limit} UNION ALL SELECT {COLS} FROM {source} WHERE diff IS NULL"""


@query("drop_flat_lines", _flat("dirty", 4), "dirty", "diff value")
def _(v):
    return cleaning.drop_flat_lines(v.dirty, D, 4)


@query(
    "drop_positive_jumps",
    f"SELECT {COLS} FROM (SELECT *, median(diff) OVER (PARTITION BY id) AS m FROM dirty) WHERE diff < 3 * m",
    "dirty",
    "diff value",
)
def _(v):
    return cleaning.drop_positive_jumps(v.dirty, D, 3)


@query(
    "fill_grid",
    """SELECT id, g AS datetime, CASE WHEN g = datetime THEN diff END AS diff, CASE WHEN g = datetime THEN value END AS value, source
    FROM (SELECT *, unnest(generate_series(datetime, coalesce(n - INTERVAL 1 DAY, datetime), INTERVAL 1 DAY)) AS g
      FROM (SELECT *, lead(datetime) OVER (PARTITION BY id ORDER BY datetime) AS n FROM dirty))""",
    "dirty",
    "diff value",
)
def _(v):
    return cleaning.fill_grid(v.dirty, D, ["source"])


def _split(source: str, gap: int, unit: str = "day") -> str:
    return f"""SELECT CASE WHEN parts = 1 THEN id ELSE id || '-' || part END AS id, datetime, diff, value, source FROM (
      SELECT *, max(part) OVER (PARTITION BY id) + 1 AS parts,
        date_diff('{unit}', min(datetime) OVER (PARTITION BY id, part), max(datetime) OVER (PARTITION BY id, part)) + 1 AS len
      FROM (SELECT *, sum(CASE WHEN date_diff('{unit}', p, datetime) - 1 >= {gap} THEN 1 ELSE 0 END) OVER w AS part
        FROM (SELECT *, lag(datetime) OVER w AS p FROM {source} {W}) {W}))
    WHERE parts = 1 OR len > {gap}"""


@query("split_at_gaps", _split("dirty", 2), "dirty", "diff value")
def _(v):
    return cleaning.split_at_gaps(v.dirty, D, 2)


@query("split_at_gaps_long", _split("dirty", 7), "dirty", "diff value")
def _(v):
    return cleaning.split_at_gaps(v.dirty, D, 7)


def _interpolated(source: str, unit: str = "day") -> str:
    return f"""SELECT id, datetime, source, value, CASE WHEN p IS NULL THEN first_diff ELSE value - p END AS diff FROM (
      SELECT *, lag(value) OVER w AS p FROM (
        SELECT id, datetime, source, first_diff, CASE WHEN v IS NOT NULL THEN v
          WHEN a.t IS NULL THEN b.v WHEN b.t IS NULL THEN a.v
          ELSE a.v + (b.v - a.v) * date_diff('{unit}', a.t, datetime) / date_diff('{unit}', a.t, b.t) END AS value
        FROM (SELECT *,
            last_value(CASE WHEN v IS NOT NULL THEN {{t: datetime, v: v}} END IGNORE NULLS) OVER (PARTITION BY id ORDER BY datetime) AS a,
            first_value(CASE WHEN v IS NOT NULL THEN {{t: datetime, v: v}} END IGNORE NULLS) OVER (PARTITION BY id ORDER BY datetime
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b
          FROM (SELECT g.id, g.datetime, g.source, g.first_diff, r.value AS v FROM (
              SELECT id, any_value(source) AS source, arg_min(COALESCE(diff, 'nan'), datetime) AS first_diff,
                unnest(generate_series(min(datetime), max(datetime), INTERVAL 1 {unit})) AS datetime
              FROM {source} GROUP BY id) g LEFT JOIN {source} r ON g.id = r.id AND g.datetime = r.datetime)))
      {W})"""


_HOLES = "(SELECT id, datetime, diff, source, CASE WHEN (CAST(id AS BIGINT) + day(datetime)) % 5 > 1 THEN value END AS value FROM readings)"


@query("interpolate_linear", _interpolated(_HOLES), "readings", "diff value")
def _(v):
    known = (F.col("id").cast("bigint") + F.dayofmonth("datetime")) % 5 > 1
    return cleaning.interpolate_linear(v.readings.withColumn("value", F.when(known, F.col("value"))), D)


@query(
    "ffill",
    f"SELECT id, datetime, last_value(diff IGNORE NULLS) OVER w AS diff, last_value(CASE WHEN diff > 100 THEN value END IGNORE NULLS) OVER w AS value FROM dirty {W}",
    "dirty",
    "diff value",
)
def _(v):
    df = v.dirty.select("id", "datetime", "diff", F.when(F.col("diff") > 100, F.col("value")).alias("value"))
    return cleaning.ffill(df, ["diff", "value"], D)


@query(
    "active_range",
    """SELECT id, datetime, coalesce(x, 0) AS x FROM (
      SELECT id, datetime, x, min(CASE WHEN x IS NOT NULL THEN datetime END) OVER (PARTITION BY id) AS lo,
        max(CASE WHEN x IS NOT NULL THEN datetime END) OVER (PARTITION BY id) AS hi
      FROM (SELECT id, datetime, CASE WHEN diff > 60 THEN diff END AS x FROM dirty)) WHERE datetime BETWEEN lo AND hi""",
    "dirty",
    "x",
)
def _(v):
    df = v.dirty.select("id", "datetime", F.when(F.col("diff") > 60, F.col("diff")).alias("x"))
    return cleaning.active_range(df, "x", D)


@query(
    "resample_last",
    """SELECT id, g AS ts, event_type, CASE WHEN g = day THEN value END AS value, CASE WHEN g = day THEN 1 ELSE 0 END AS open,
      CASE WHEN g = day THEN ln(value) END AS log_sales
    FROM (SELECT *, unnest(generate_series(day, coalesce(lead(day) OVER (PARTITION BY id ORDER BY day) - INTERVAL 1 DAY, day), INTERVAL 1 DAY)) AS g
      FROM (SELECT CAST(user_id AS VARCHAR) AS id, date_trunc('day', ts) AS day, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value
        FROM events GROUP BY 1, 2))""",
    floats="value log_sales",
    ints="open",
)
def _(v):
    df = v.table("events").select(F.col("user_id").cast("string").alias("id"), "ts", "event_type", "value")
    return cleaning.resample_last(df, ["event_type"], "value", Series("day", time="ts", points=7))


@query(
    "prev_next",
    f"""SELECT * FROM (SELECT id, datetime, diff, lag(diff) OVER w AS prev_diff, lead(diff) OVER w AS next_diff FROM dirty {W})
    WHERE diff IS NOT NULL AND prev_diff IS NOT NULL AND next_diff IS NOT NULL""",
    "dirty",
    "diff prev_diff next_diff",
)
def _(v):
    return cleaning.prev_next(v.dirty.select("id", "datetime", "diff"), "diff", D)


def _basic(source: str, unit: str, gap: int) -> str:
    return f"""a AS (SELECT * FROM {source} WHERE diff >= 0),
    b AS ({_reconnect('a', unit, gap)}),
    c AS (SELECT b.id, datetime, diff, value, source FROM b JOIN ({_bounds('b')}) q ON b.id = q.id WHERE diff <= q75 + 1.5 * (q75 - q25)),
    d AS ({_flat('c', 4)})"""


@query("clean_basic", f"WITH {_basic('dirty', 'day', 1)} SELECT {COLS} FROM d", "dirty", "diff value")
def _(v):
    return chains.clean_basic(v.dirty, D, 4)


@query("clean_basic_hourly", f"WITH {_basic('dirty_hourly', 'hour', 3)} SELECT {COLS} FROM d", "dirty_hourly", "diff value")
def _(v):
    return chains.clean_basic(v.dirty_hourly, H, 4)


def _whole(source: str, unit: str, reconnect: int, gap: int) -> str:
    return f"""WITH {_basic(source, unit, reconnect)}, e AS ({_split('d', gap, unit)}), f AS ({_interpolated('e', unit)}),
    g AS (SELECT * FROM f WHERE diff >= 0),
    h AS (SELECT * EXCLUDE (m) FROM (SELECT *, median(diff) OVER (PARTITION BY id) AS m FROM g) WHERE diff < 50 * m)
    SELECT {COLS} FROM ({_split('h', 1, unit)})"""


@query("clean_interpolated", _whole("dirty", "day", 1, 7), "dirty", "diff value")
def _(v):
    return chains.clean_interpolated(v.dirty, D, 4, 7)


@query("clean_interpolated_hourly", _whole("dirty_hourly", "hour", 3, 24), "dirty_hourly", "diff value")
def _(v):
    return chains.clean_interpolated(v.dirty_hourly, H, 4)


@query("incremental_dataset", f"SELECT id, datetime, value, source, value - lag(value) OVER w AS diff FROM readings {W}", "readings", "diff value")
def _(v):
    """Readings that come in three batches, the last with days that were missing in between, as one run over all of them."""
    path, s = new_path(v.spark), Series("day", points=6)
    rows = v.readings.select("source", "id", "datetime", "value")
    day = F.dayofmonth("datetime")
    late = (day % 11 == 0) & (F.col("source") == "s0")
    for part in (rows.filter((day <= 20) & ~late), rows.filter((day > 20) & ~late), rows.filter(late)):
        incremental.ingest(part, path, s)
    return incremental.dataset(v.spark, path)
