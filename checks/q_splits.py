"""Splits, encoding, scaling, augmentation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import D
from heatloom.functions.tables import materialize, new_path, shared_folder
from heatloom.operators import encoding, frames, rows, scaling, splits
from heatloom.schema import feature_columns

CUT = "CAST(0.8 AS DOUBLE)"


def readings(v):
    return v.readings.select("id", "datetime", "diff")


def dirty(v):
    return v.dirty.select("id", "datetime", "diff")


@query("split_time", "SELECT id, datetime, diff, split FROM split_rows", "split_rows", "diff")
def _(v):
    return splits.split_time(readings(v), 0.8, D)


@query(
    "split_discard_short",
    """SELECT id, datetime, diff, split FROM split_dirty WHERE id IN (
      SELECT id FROM (SELECT id, split, count(*) AS c FROM split_dirty GROUP BY 1, 2) GROUP BY id HAVING min(c) > 1 AND count(*) = 3)""",
    "split_dirty",
    "diff",
)
def _(v):
    return splits.split_discard_short(dirty(v), 1, 0.8, D)


@query(
    "discarded_ids",
    """SELECT DISTINCT id FROM split_dirty WHERE id NOT IN (
      SELECT id FROM (SELECT id, split, count(*) AS c FROM split_dirty GROUP BY 1, 2) GROUP BY id HAVING min(c) > 1 AND count(*) = 3)""",
    "split_dirty",
)
def _(v):
    return splits.discarded_ids(dirty(v), 1, 0.8, D)


@query(
    "train_head_removal",
    """SELECT id, datetime, diff, split FROM (SELECT *, count(*) OVER (PARTITION BY id, split) AS c,
        row_number() OVER (PARTITION BY id, split ORDER BY datetime DESC) AS k FROM split_rows)
    WHERE split <> 'train' OR k <= floor(c * (1 - CAST(0.3 AS DOUBLE)))""",
    "split_rows",
    "diff",
)
def _(v):
    return splits.train_head_removal(readings(v), 0.3, 0.8, D)


def _dated(head: bool = False) -> str:
    cut = "TIMESTAMP '2024-01-20'"
    train = "floor(t * CAST(0.5 AS DOUBLE))" if head else "t"
    return f"""SELECT id, datetime, diff, split FROM (
      SELECT *, {train} AS kept FROM (
        SELECT *, least(floor(m * CAST(0.9 AS DOUBLE)) + 1, m) AS t,
          CASE WHEN datetime < {cut} AND i <= floor(m * CAST(0.9 AS DOUBLE)) THEN 'train' WHEN datetime < {cut} THEN 'val'
            WHEN datetime > {cut} THEN 'test' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY datetime) - 1 AS i,
            count(*) FILTER (datetime < {cut}) OVER (PARTITION BY id) AS m,
            count(*) FILTER (datetime > {cut}) OVER (PARTITION BY id) AS a FROM dirty)))
    WHERE split IS NOT NULL AND (m = 0 OR (kept >= 1 AND m - t >= 1)) AND (split <> 'test' OR a > 1)
      AND (split <> 'train' OR i < kept)"""


@query("split_date", _dated(), "dirty", "diff")
def _(v):
    return splits.split_date(dirty(v), "2024-01-20", 1, D)


@query("split_date_head", _dated(True), "dirty", "diff")
def _(v):
    return splits.split_date(dirty(v), "2024-01-20", 1, D, remove_per=0.5)


@query(
    "split_fixed_dates",
    """SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1998-08-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '1998-11-01' THEN 'val'
      ELSE 'test' END AS split FROM orders""",
)
def _(v):
    df = splits.split_fixed_dates(v.table("orders"), "1998-08-01", "1998-11-01", "o_orderdate")
    return df.select("o_orderkey", "split")


@query(
    "split_id_list",
    """SELECT id, datetime, diff, CASE CAST(id AS BIGINT) % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split
    FROM readings WHERE CAST(id AS BIGINT) % 4 < 3""",
    "readings",
    "diff",
)
def _(v):
    """The lists are made from the ids, written as JSON and read back."""
    k = F.col("user_id") % 4
    ids = v.table("events").select("user_id").distinct()
    one = F.array(F.col("user_id").cast("string"))
    lists = [F.when(k == i, one).alias(f"{n}_ids") for i, n in enumerate(("train", "val", "test"))]
    path = f"{shared_folder(v.spark)}/heatloom/{uuid.uuid4().hex}"
    ids.select(*lists).write.json(path)
    return splits.split_id_list(readings(v), splits.scan_split_lists(v.spark, path))


@query(
    "split_group",
    """WITH u AS (SELECT id, row_number() OVER (ORDER BY md5(id || '|42')) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT id FROM readings)),
    c AS (SELECT *, ceil(n * (1 - CAST(0.8 AS DOUBLE))) AS t FROM u)
    SELECT id, datetime, diff, CASE WHEN r < n - t THEN 'train' WHEN r < n - ceil(t / 2) THEN 'test' ELSE 'val' END AS split
    FROM readings JOIN c USING (id)""",
    "readings",
    "diff",
)
def _(v):
    return splits.split_group(readings(v), 0.8, 42, D)


@query(
    "split_group_sizes",
    """SELECT unnest(['train', 'test', 'val']) AS split, unnest([n - t, t - v, v]) AS series FROM (
      SELECT n, t, CAST(ceil(t / 2) AS BIGINT) AS v FROM (
        SELECT n, CAST(ceil(n * (1 - CAST(0.8 AS DOUBLE))) AS BIGINT) AS t FROM (SELECT count(DISTINCT user_id) AS n FROM events)))""",
)
def _(v):
    parts = splits.split_group(readings(v), 0.8, 42, D)
    return parts.groupBy("split").agg(F.countDistinct("id").alias("series"))


_DAYS = "SELECT event_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days_from_start FROM events"


@query(
    "split_boundary_overlap",
    f"""SELECT *, 'train' AS split FROM ({_DAYS}) WHERE days_from_start < 15
    UNION ALL SELECT *, 'val' FROM ({_DAYS}) WHERE days_from_start >= 8 AND days_from_start < 22
    UNION ALL SELECT *, 'test' FROM ({_DAYS}) WHERE days_from_start >= 15""",
)
def _(v):
    df = rows.elapsed_time(v.table("events").select("event_id", "ts"), "day", "2024-01-01", "ts").drop("ts")
    return splits.split_boundary_overlap(df, 15, 22, 7)


@query(
    "split_year",
    """SELECT Symbol, date, CASE WHEN year(date) < 1998 THEN 'train' WHEN year(date) < 2000 THEN 'val' ELSE 'test' END AS split
    FROM volatility WHERE year(date) < 2000 OR date <= TIMESTAMP '2001-06-28'""",
    "volatility",
)
def _(v):
    return splits.split_year(v.volatility.select("Symbol", "date"), 1998, 2000, "2001-06-28")


@query("select_split", "SELECT id, datetime, diff FROM split_rows WHERE split = 'val'", "split_rows", "diff")
def _(v):
    return splits.select_split(splits.split_time(readings(v), 0.8, D), "val")


@query(
    "xy_columns",
    """SELECT s.id, s.datetime, split, s.value, s.diff, l."diff(t+1)" FROM split_rows s JOIN (
      SELECT id, datetime, lead(diff) OVER (PARTITION BY id ORDER BY datetime) AS "diff(t+1)" FROM readings) l USING (id, datetime)""",
    "split_rows",
    "value diff diff(t+1)",
)
def _(v):
    df = frames.lag_lead_columns(v.readings.select("id", "datetime", "diff", "value"), 0, 2, D)
    return splits.xy_columns(splits.split_time(df, 0.8, D), ["value", "diff"], 2, s=D)


# ---- encoding and scaling --------------------------------------------------------------------------------------


@query(
    "label_encode",
    "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c_mktsegment FROM customer",
)
def _(v):
    return scaling.label_encode(v.table("customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], by="c_custkey")


@query(
    "one_hot",
    "SELECT event_id, " + ", ".join(f"CAST(event_type = '{t}' AS DOUBLE) AS event_type_{t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events",
)
def _(v):
    return scaling.one_hot(v.table("events").select("event_id", "event_type"), ["event_type"])[0]


TRAIN = "FILTER (split = 'train') OVER ({})"


def _z(col: str, over: str = "", std: str = "stddev_pop") -> str:
    part = TRAIN.format(over)
    return f"({col} - avg({col}) {part}) / coalesce(nullif({std}({col}) {part}, 0), 1)"


def split_rows(v):
    return splits.split_time(v.readings, 0.8, D)


@query(
    "standardize_global",
    f"SELECT id, datetime, split, {_z('diff')} AS diff, {_z('value')} AS value FROM split_rows",
    "split_rows",
    "diff value",
)
def _(v):
    return scaling.standardize_global(split_rows(v), ["diff", "value"]).drop("source")


@query(
    "minmax_global",
    """SELECT id, datetime, split, (diff - min(diff) FILTER (split = 'train') OVER ())
      / (max(diff) FILTER (split = 'train') OVER () - min(diff) FILTER (split = 'train') OVER ()) AS diff FROM split_rows""",
    "split_rows",
    "diff",
)
def _(v):
    return scaling.minmax_global(split_rows(v), ["diff"]).drop("source", "value")


_NAMED = """SELECT *, regexp_replace(id, '(-\\d+)?-\\d+$', '') AS base_id FROM (
      SELECT id || CASE WHEN day(datetime) > 12 THEN '-1' ELSE '' END AS id, datetime, split, diff, value FROM split_rows)"""


@query(
    "standardize_per_series",
    f"SELECT id, base_id, datetime, split, {_z('diff', 'PARTITION BY base_id')} AS diff, {_z('value')} AS value FROM ({_NAMED})",
    "split_rows",
    "diff value",
)
def _(v):
    df = split_rows(v).drop("source")
    part = F.when(F.dayofmonth("datetime") > 12, F.concat("id", F.lit("-1"))).otherwise(F.col("id"))
    return scaling.standardize_per_series(materialize(df.withColumn("id", part)), "diff", ["value"], s=D)


@query(
    "standardize_per_entity",
    f"""SELECT id, datetime, split, {_z('diff', 'PARTITION BY id')} AS diff, {_z('value', 'PARTITION BY id')} AS value FROM split_rows
    QUALIFY count(*) {TRAIN.format('PARTITION BY id')} >= 22""",
    "split_rows",
    "diff value",
)
def _(v):
    return scaling.standardize_per_entity(materialize(split_rows(v).drop("source")), ["diff", "value"], 22)


@query(
    "inverse_scale",
    """SELECT p.id, p.datetime, h, y, CASE WHEN s IS NULL THEN y_hat ELSE y_hat * s + m END AS y_hat FROM pred p LEFT JOIN (
      SELECT id, avg(diff) AS m, stddev_pop(diff) AS s FROM readings WHERE CAST(id AS BIGINT) % 5 <> 0 GROUP BY id) q USING (id)""",
    "pred",
    "y y_hat",
    "h",
)
def _(v):
    known = v.readings.filter(F.col("id").cast("bigint") % 5 != 0).withColumnRenamed("id", "base_id")
    return scaling.inverse_scale(v.pred, scaling.fit_scaler(known, ["diff"], by="base_id"))


@query(
    "fill_before_scale",
    "SELECT id, coalesce(typ, 'unknown') AS typ, coalesce(heated_area, 0) AS heated_area FROM (SELECT id, typ, nullif(heated_area, 0) AS heated_area FROM meta)",
    "meta",
    "heated_area",
)
def _(v):
    df = v.meta.select("id", "typ", F.nullif("heated_area", F.lit(0.0)).alias("heated_area"))
    return scaling.fill_before_scale(df, ["heated_area"], ["typ"])


@query(
    "column_transformer",
    f"""SELECT id, datetime, split, {_z('value')} AS value, {_z('diff')} AS diff, CAST(isodow(datetime) > 5 AS BIGINT) AS weekend,
      CAST(source = 's0' AS DOUBLE) AS source_s0, CAST(source = 's1' AS DOUBLE) AS source_s1 FROM split_rows""",
    "split_rows",
    "value diff",
)
def _(v):
    df = rows.weekend_flag(split_rows(v))
    return scaling.column_transformer(df, ["value"], ["source"], ["weekend"])[0]


@query(
    "feature_registry",
    "SELECT id, datetime, diff, value * 2 AS hum_avg, value + 1 AS tmax, value - 1 AS tsun, value * 3 AS wpgt FROM readings",
    "readings",
    "diff hum_avg tmax tsun wpgt",
)
def _(v):
    x = F.col("value")
    weather = {"hum_avg": x * 2, "tmax": x + 1, "tsun": x - 1, "wpgt": x * 3, "unused": x}
    return v.readings.withColumns(weather).select("id", "datetime", *feature_columns(4))


_NAIVE = """SELECT id, datetime, diff, p AS diff_n, p AS "diff(t+1)_n"
    FROM (SELECT id, datetime, diff, lag(diff) OVER (PARTITION BY id ORDER BY datetime) AS p FROM readings)"""


@query("persistence_forecast", _NAIVE, "readings", "diff diff_n diff(t+1)_n")
def _(v):
    return scaling.persistence_forecast(readings(v), ["diff"], 2, s=D)


@query(
    "noise_rmse",
    f"SELECT f AS feature, sqrt(avg((diff - diff_n) ** 2)) AS rmse FROM ({_NAIVE}), (VALUES ('diff'), ('mean')) AS t(f) GROUP BY f",
    "readings",
    "rmse",
)
def _(v):
    return scaling.noise_rmse(scaling.persistence_forecast(readings(v), ["diff"], 2, s=D), ["diff"])


@query(
    "swap_in_noise",
    f"""SELECT s.id, s.datetime, split, CASE WHEN split = 'test' THEN diff_n ELSE s.diff END AS diff,
      CASE WHEN split = 'test' THEN "diff(t+1)_n" ELSE nxt END AS "diff(t+1)"
    FROM split_rows s JOIN ({_NAIVE}) o USING (id, datetime)
    JOIN (SELECT id, datetime, lead(diff) OVER (PARTITION BY id ORDER BY datetime) AS nxt FROM readings) l USING (id, datetime)
    WHERE split <> 'test' OR diff_n IS NOT NULL""",
    "split_rows",
    "diff diff(t+1)",
)
def _(v):
    df = materialize(frames.lag_lead_columns(readings(v), 0, 2, D))
    df = scaling.persistence_forecast(df, ["diff"], 2, s=D)
    return scaling.swap_in_noise(splits.split_time(df, 0.8, D), ["diff"], 2)




@query(
    "sparse_encoder",
    """WITH codes AS (SELECT category, row_number() OVER (ORDER BY k, category) - 1 AS place, k FROM (
        SELECT DISTINCT 0 AS k, event_type AS category FROM events WHERE event_id % 4 > 0 AND event_type <> 'view'
        UNION ALL SELECT DISTINCT 1, CAST(user_id AS VARCHAR) FROM events WHERE event_id % 4 > 0 AND event_type <> 'view')),
    p AS (SELECT avg(value) AS a, stddev_pop(value) AS s FROM events WHERE event_id % 4 > 0 AND event_type <> 'view')
    SELECT event_id, 0 AS place, (value - a) / s AS value FROM events, p WHERE value IS NOT NULL
    UNION ALL SELECT event_id, 1 + place, 1.0 FROM events JOIN codes ON k = 0 AND category = event_type
    UNION ALL SELECT event_id, 1 + place, 1.0 FROM events JOIN codes ON k = 1 AND category = CAST(user_id AS VARCHAR)
    UNION ALL SELECT event_id, 1 + (SELECT count(*) FROM codes), CAST(dayofweek(ts) IN (0, 6) AS DOUBLE) FROM events""",
    "",
    "value",
    "place",
)
def _(v):
    """Fitted on a part without one type, stored, read again and applied to all events: one row per entry of a vector."""
    events = v.table("events").withColumn("weekend", (F.weekday("ts") >= 5).cast("double"))
    train = events.filter("event_id % 4 > 0 AND event_type <> 'view'")
    path = new_path(v.spark)
    encoding.Encoder.fit(train, ["value"], ["event_type", "user_id"], ["weekend"]).save(path)
    rows = encoding.Encoder.load(v.spark, path).transform(events, by="event_id")
    return rows.select("event_id", F.inline(F.arrays_zip(F.col("indices").alias("place"), F.col("values").alias("value"))))
