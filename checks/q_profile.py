"""Aggregations, gaps and descriptive statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import D, H
from heatloom.operators import profile

DAY = "INTERVAL 1 DAY"
READING = "id, datetime, diff, value, source"
GAPS = "SELECT id, lag(datetime) OVER (PARTITION BY id ORDER BY datetime) AS p, datetime FROM readings"


@query("date_ranges", "SELECT id, min(datetime) AS min_date, max(datetime) AS max_date, count(*) AS n FROM readings GROUP BY id", "readings")
def _(v):
    return profile.date_ranges(v.readings)


@query(
    "date_spine",
    f"SELECT id, unnest(generate_series(min(datetime), max(datetime), {DAY})) AS datetime FROM readings GROUP BY id",
    "readings",
)
def _(v):
    return profile.date_spine(v.readings, D)


_COVERAGE = """SELECT id, date_diff('day', min(datetime), max(datetime)) + 1 - count(*) AS len, count(*) AS n,
      count(*) / (date_diff('day', min(datetime), max(datetime)) + 2) * 100 AS per,
      min(datetime) AS start_date, max(datetime) AS end_date FROM {} GROUP BY id"""


@query("missing_points", _COVERAGE.format("readings"), "readings", "per")
def _(v):
    return profile.missing_points(v.readings, D)


_MISSING = f"SELECT id, unnest(generate_series(p + {DAY}, datetime - {DAY}, {DAY})) AS missing_date FROM ({GAPS}) WHERE p IS NOT NULL"


@query("missing_dates", _MISSING, "readings")
def _(v):
    return profile.missing_dates(v.readings, D)


@query(
    "missing_lists",
    f"""SELECT id, CAST(floor(epoch(missing_date) / 604800) AS BIGINT) AS slice, count(*) AS len,
      string_agg(strftime(missing_date, '%m-%d'), ' ' ORDER BY missing_date) AS missing_dates FROM ({_MISSING}) GROUP BY 1, 2""",
    "readings",
)
def _(v):
    text = F.concat_ws(" ", F.transform("missing_dates", lambda d: F.date_format(d, "MM-dd")))
    return profile.missing_lists(v.readings, D).withColumn("missing_dates", text)


@query(
    "coverage_filter",
    f"SELECT * FROM readings WHERE id IN (SELECT id FROM ({_COVERAGE.format('readings')}) WHERE per > 90)",
    "readings",
    "diff value",
)
def _(v):
    return profile.coverage_filter(v.readings, D)


@query(
    "gap_spans",
    f"""SELECT id, p + {DAY} AS "start", datetime - {DAY} AS "end", date_diff('day', p, datetime) - 1 AS n
    FROM ({GAPS}) WHERE date_diff('day', p, datetime) > 1""",
    "readings",
)
def _(v):
    return profile.gap_spans(v.readings, D)


@query(
    "rollup_daily_sum",
    "SELECT id, date_trunc('day', datetime) AS datetime, sum(diff) AS diff FROM hourly GROUP BY 1, 2",
    "hourly",
    "diff",
)
def _(v):
    return profile.rollup_daily_sum(v.hourly, H)


_HUMIDITY = """SELECT plz, date_trunc('day', datetime) AS datetime, avg(rhum) AS hum_avg, min(rhum) AS hum_min, max(rhum) AS hum_max
    FROM weather GROUP BY 1, 2"""


@query("rollup_humidity", _HUMIDITY, "weather", "hum_avg hum_min hum_max")
def _(v):
    return profile.rollup_humidity(v.weather, "datetime")


@query(
    "weather_merge",
    f"SELECT h.*, tavg, tmin, tmax, prcp FROM ({_HUMIDITY}) h LEFT JOIN (SELECT * FROM weather_daily WHERE plz % 5 <> 0) USING (plz, datetime)",
    "weather weather_daily",
    "hum_avg hum_min hum_max tavg tmin tmax",
)
def _(v):
    daily = v.weather_daily.filter("plz % 5 <> 0")
    return profile.weather_merge(profile.rollup_humidity(v.weather, "datetime"), daily, "datetime")


@query(
    "rollup_hourly_mean",
    "SELECT id, date_trunc('hour', ts) AS ts, nullif(avg(usage), 0) AS usage FROM quarter_hours GROUP BY 1, 2",
    "quarter_hours",
    "usage",
)
def _(v):
    return profile.rollup_hourly_mean(v.quarter_hours, ["usage"], ["id"], "ts")


@query(
    "building_stats",
    """SELECT id, avg(diff) AS avg, stddev_samp(diff) AS std, median(diff) AS median, min(diff) AS min, max(diff) AS max,
      count(*) AS len, list_sum(list(diff ORDER BY datetime)[1:10]) AS head_sum, least(count(*), 10) AS head_len
    FROM readings GROUP BY id""",
    "readings",
    "avg std median min max head_sum",
)
def _(v):
    out = profile.building_stats(v.readings, D, head=10)
    total = F.aggregate("month", F.lit(0.0), lambda a, x: a + x)
    return out.withColumns({"head_sum": total, "head_len": F.size("month")}).drop("month")


@query("length_filter", "SELECT id, count(*) AS len FROM readings GROUP BY id HAVING count(*) >= 27", "readings")
def _(v):
    return profile.length_filter(v.readings, 27)


@query(
    "drop_all_null_series",
    "SELECT * FROM (SELECT *, CASE WHEN CAST(id AS BIGINT) % 6 <> 0 THEN diff END AS f FROM readings) WHERE CAST(id AS BIGINT) % 6 <> 0",
    "readings",
    "diff value f",
)
def _(v):
    df = v.readings.withColumn("f", F.when(F.col("id").cast("bigint") % 6 != 0, F.col("diff")))
    return profile.drop_all_null_series(df, ["f", "value"], D)


@query(
    "filter_groups_min",
    "SELECT * FROM (SELECT *, min(unit_sales) OVER (PARTITION BY store_nbr, item_nbr % 200) AS m FROM sales) WHERE m >= 0",
    "sales",
    "unit_sales m",
    "onpromotion",
)
def _(v):
    df = v.sales.withColumn("traj", F.concat_ws("_", "store_nbr", F.col("item_nbr") % 200))
    lowest = df.groupBy("traj").agg(F.min("unit_sales").alias("m"))
    kept = profile.filter_groups_min(df, "traj", "unit_sales", 0, ["date", "item_nbr"])
    return kept.join(lowest, "traj").drop("traj")


@query(
    "series_length_report",
    """WITH l AS (SELECT id, CAST(count(*) AS DOUBLE) AS len FROM readings GROUP BY id)
    SELECT * FROM l UNION ALL SELECT 'mean', avg(len) FROM l UNION ALL SELECT 'median', median(len) FROM l
    UNION ALL SELECT 'std', stddev_samp(len) FROM l""",
    "readings",
    "len",
)
def _(v):
    return profile.series_length_report(v.readings)


@query(
    "mode_value",
    """WITH a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events GROUP BY 1, 2),
    b AS (SELECT user_id, hour(ts) AS h, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, hour(ts)) AS k FROM events GROUP BY 1, 2)
    SELECT user_id, event_type, h FROM a JOIN b USING (user_id) WHERE a.k = 1 AND b.k = 1""",
    ints="h",
)
def _(v):
    return profile.mode_value(v.table("events").withColumn("h", F.hour("ts")), "user_id", ["event_type", "h"])


@query(
    "dedup_keys",
    """SELECT user_id, event_type, value, event_id FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) AS k FROM events) WHERE k = 1""",
    floats="value",
)
def _(v):
    df = v.table("events").select("user_id", "event_type", "value", "event_id")
    return profile.dedup_keys(df, ["user_id", "event_type"], ["value"])


def _described(col: str) -> str:
    return f"""SELECT '{col}' AS "column", count({col}) AS count, avg({col}) AS mean, stddev_samp({col}) AS std, min({col}) AS min,
      max({col}) AS max, quantile_cont({col}, 0.25) AS q25, quantile_cont({col}, 0.5) AS q50, quantile_cont({col}, 0.75) AS q75 FROM lineitem"""


@query(
    "describe_columns",
    " UNION ALL ".join(_described(c) for c in ("l_quantity", "l_extendedprice", "l_discount")),
    floats="mean std min max q25 q50 q75",
)
def _(v):
    return profile.describe_columns(v.table("lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query(
    "missingness_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS type, count({c}) AS non_null, count(*) - count({c}) AS missing,
        (count(*) - count({c})) / count(*) * 100 AS missing_pct FROM dirty"""
        for c, t in (("id", "string"), ("datetime", "timestamp_ntz"), ("diff", "double"), ("value", "double"), ("source", "string"))
    ),
    "dirty",
    "missing_pct",
)
def _(v):
    return profile.missingness_profile(v.dirty)


@query(
    "histogram",
    """WITH e AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 50 AS w FROM events),
    c AS (SELECT least(floor((value - lo) / w), 49) AS bin, count(*) AS count FROM events, e GROUP BY 1)
    SELECT b.bin, lo + w * b.bin AS "start", lo + w * (b.bin + 1) AS "end", coalesce(count, 0) AS count
    FROM (SELECT unnest(range(50)) AS bin) b CROSS JOIN e LEFT JOIN c ON b.bin = c.bin""",
    floats="start end",
)
def _(v):
    return profile.histogram(v.table("events"), "value", 50)


def _facts(view: str, name: str) -> str:
    return f"""SELECT unnest(['rows', 'columns', 'devices', 'start', 'end', 'mean', 'std', 'min', 'max']) AS metric,
      unnest([CAST(count(*) AS VARCHAR), '5', CAST(count(DISTINCT id) AS VARCHAR), strftime(min(datetime), '%Y-%m-%d %H:%M:%S'),
        strftime(max(datetime), '%Y-%m-%d %H:%M:%S'), printf('%.2f', avg(diff)), printf('%.2f', stddev_samp(diff)),
        printf('%.2f', min(diff)), printf('%.2f', max(diff))]) AS {name} FROM {view}"""


@query(
    "dataset_comparison",
    f"SELECT * FROM ({_facts('readings', 'first')}) JOIN ({_facts('hourly', 'second')}) USING (metric)",
    "readings hourly",
)
def _(v):
    return profile.dataset_comparison(v.readings, v.hourly)


def split_rows(v):
    from heatloom.operators.splits import split_time

    return split_time(v.readings, 0.8, D)


@query(
    "split_date_ranges",
    """SELECT split, min(datetime) AS "start", max(datetime) AS "end", count(*) AS samples,
      date_diff('day', min(datetime), max(datetime)) AS steps FROM split_rows GROUP BY split""",
    "split_rows",
)
def _(v):
    return profile.split_date_ranges(split_rows(v))


@query(
    "split_series_stats",
    """SELECT split, count(*) AS series, min(n) AS min, max(n) AS max, avg(n) AS mean, median(n) AS median
    FROM (SELECT split, id, count(*) AS n FROM split_rows GROUP BY 1, 2) GROUP BY split""",
    "split_rows",
    "mean median",
)
def _(v):
    return profile.split_series_stats(split_rows(v))


@query(
    "reduction_report",
    """WITH s AS (SELECT 0 AS i, 'all' AS stage, count(*) AS rows, count(DISTINCT id) AS series FROM dirty
      UNION ALL SELECT 1, 'known', count(*), count(DISTINCT id) FROM dirty WHERE diff IS NOT NULL
      UNION ALL SELECT 2, 'positive', count(*), count(DISTINCT id) FROM dirty WHERE diff > 150)
    SELECT stage, rows, series, (SELECT rows FROM s WHERE i = 0) - rows AS rows_lost,
      ((SELECT rows FROM s WHERE i = 0) - rows) / (SELECT rows FROM s WHERE i = 0) * 100 AS rows_lost_pct,
      (SELECT series FROM s WHERE i = 0) - series AS series_lost FROM s""",
    "dirty",
    "rows_lost_pct",
)
def _(v):
    known = v.dirty.filter("diff is not null")
    return profile.reduction_report([("all", v.dirty), ("known", known), ("positive", known.filter("diff > 150"))])


@query("split_shares", "SELECT split, count(*) AS rows, count(*) / sum(count(*)) OVER () * 100 AS pct FROM split_rows GROUP BY split", "split_rows", "pct")
def _(v):
    return profile.split_shares(split_rows(v))


@query(
    "longest_series_head",
    """SELECT * FROM readings WHERE id = (SELECT id FROM readings GROUP BY id ORDER BY count(*) DESC, id LIMIT 1)
    ORDER BY datetime LIMIT 20""",
    "readings",
    "diff value",
)
def _(v):
    return profile.longest_series_head(v.readings, 20, D)


@query(
    "time_window_slice",
    """SELECT id, datetime, diff FROM (SELECT *, min(datetime) OVER (PARTITION BY id) AS s FROM readings)
    WHERE datetime <= s + INTERVAL 14 DAY""",
    "readings",
    "diff",
)
def _(v):
    return profile.time_window_slice(v.readings.select("id", "datetime", "diff"), 14, D)


@query(
    "sample_rows",
    f"SELECT {READING} FROM readings ORDER BY md5(id || '|' || CAST(datetime AS VARCHAR) || '|42') LIMIT 1000",
    "readings",
    "diff value",
)
def _(v):
    return profile.sample_rows(v.readings, 1000)
