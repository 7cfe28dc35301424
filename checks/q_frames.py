"""Lags, supervised frames, windows and tensors."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.views import D
from heatloom.operators import frames
from heatloom.schema import Role

W = "WINDOW w AS (PARTITION BY id ORDER BY datetime)"
LAGS = """lag(diff, 1) OVER w AS "diff(t-1)", lag(diff, 2) OVER w AS "diff(t-2)", lag(diff, 3) OVER w AS "diff(t-3)",
    lead(diff, 1) OVER w AS "diff(t+1)" """
NAMES = "diff diff(t-1) diff(t-2) diff(t-3) diff(t+1)"


def dirty(v):
    return v.dirty.select("id", "datetime", "diff")


@query("lag_lead_columns", f"SELECT id, datetime, diff, {LAGS} FROM dirty {W}", "dirty", NAMES)
def _(v):
    return frames.lag_lead_columns(dirty(v), 3, 2, D)


@query(
    "lag_any_column",
    f"SELECT id, datetime, value, lag(value, 1) OVER w AS value_lag_1, lag(value, 2) OVER w AS value_lag_2 FROM dirty {W}",
    "dirty",
    "value value_lag_1 value_lag_2",
)
def _(v):
    return frames.lag_any_column(v.dirty.select("id", "datetime", "value"), "value", 2, D)


@query(
    "drop_incomplete_lags",
    f"""SELECT * FROM (SELECT id, datetime, diff, {LAGS} FROM dirty {W}) WHERE "diff(t-1)" IS NOT NULL AND "diff(t-2)" IS NOT NULL
    AND "diff(t-3)" IS NOT NULL AND "diff(t+1)" IS NOT NULL""",
    "dirty",
    NAMES,
)
def _(v):
    return frames.drop_incomplete_lags(frames.lag_lead_columns(dirty(v), 3, 2, D), 3, 2)


@query(
    "future_covariates",
    f"""SELECT id, datetime, diff, value, lead(diff, 1) OVER w AS "diff_t+1", lead(diff, 2) OVER w AS "diff_t+2",
      lead(value, 1) OVER w AS "value_t+1", lead(value, 2) OVER w AS "value_t+2" FROM dirty {W}""",
    "dirty",
    "diff value diff_t+1 diff_t+2 value_t+1 value_t+2",
)
def _(v):
    return frames.future_covariates(v.dirty.select("id", "datetime", "diff", "value"), ["value"], 3, D)


@query(
    "last_n_diffs",
    f"""SELECT * EXCLUDE (k) FROM (SELECT id, datetime, diff, lag(diff, 3) OVER w AS "t-3", lag(diff, 2) OVER w AS "t-2",
      lag(diff, 1) OVER w AS "t-1", row_number() OVER w AS k FROM dirty {W}) WHERE k > 3 AND diff IS NOT NULL""",
    "dirty",
    "diff t-1 t-2 t-3",
)
def _(v):
    return frames.last_n_diffs(dirty(v), 3, D)


def windowed(lag_in: int, lag_out: int, source: str = "dirty") -> str:
    """Every complete window as (id, datetime, step, diff, value), step 0 being the oldest."""
    total = lag_in + lag_out
    return f"""SELECT b.id, b.datetime, s.k - b.k + {lag_in} AS step, s.diff, s.value
    FROM (SELECT id, datetime, row_number() OVER (PARTITION BY id ORDER BY datetime) AS k FROM {source}) b
    JOIN (SELECT id, diff, value, row_number() OVER (PARTITION BY id ORDER BY datetime) AS k FROM {source}) s
      ON b.id = s.id AND s.k BETWEEN b.k - {lag_in} AND b.k + {lag_out - 1}
    QUALIFY count(*) OVER (PARTITION BY b.id, b.datetime) = {total}
      AND count(s.diff) OVER (PARTITION BY b.id, b.datetime) = {total}
      AND count(s.value) OVER (PARTITION BY b.id, b.datetime) = {total}"""


FEATURES = ["diff", "value"]


def supervised(v, lag_in: int, lag_out: int):
    return frames.supervised_frame(v.dirty, FEATURES, lag_in, lag_out, D)


def steps(df, col: str, *names: str):
    """An array column as one row per element."""
    rows = df.select("id", "datetime", F.posexplode(col).alias("step", "_x"))
    return rows.select("id", "datetime", "step", *[F.col("_x")[n].alias(n) for n in names])


@query("supervised_frame", windowed(4, 3), "dirty", "diff value", "step")
def _(v):
    return steps(supervised(v, 4, 3), "steps", "diff", "value")


@query(
    "supervised_frame_wide",
    f"""SELECT id, datetime, max(CASE step WHEN 0 THEN diff END) AS "diff(t-2)", max(CASE step WHEN 0 THEN value END) AS "value(t-2)",
      max(CASE step WHEN 1 THEN diff END) AS "diff(t-1)", max(CASE step WHEN 1 THEN value END) AS "value(t-1)",
      max(CASE step WHEN 2 THEN diff END) AS diff, max(CASE step WHEN 2 THEN value END) AS value,
      max(CASE step WHEN 3 THEN diff END) AS "diff(t+1)", max(CASE step WHEN 3 THEN value END) AS "value(t+1)"
    FROM ({windowed(2, 2)}) GROUP BY 1, 2""",
    "dirty",
    "diff value diff(t-2) value(t-2) diff(t-1) value(t-1) diff(t+1) value(t+1)",
)
def _(v):
    return frames.wide(supervised(v, 2, 2), FEATURES, 2, 2)


@query(
    "supervised_legacy",
    f"""SELECT id, datetime, step, CASE WHEN step < 3 THEN diff ELSE -99 END AS x0, value AS x1,
      max(CASE step WHEN 3 THEN diff END) OVER (PARTITION BY id, datetime) AS y0,
      max(CASE step WHEN 4 THEN diff END) OVER (PARTITION BY id, datetime) AS y1
    FROM ({windowed(3, 2)}) QUALIFY step < 4""",
    "dirty",
    "x0 x1 y0 y1",
    "step",
)
def _(v):
    df = frames.supervised_legacy(v.dirty, FEATURES, 3, 2, 1, True, D)
    rows = df.select("id", "datetime", F.posexplode("x").alias("step", "_x"), "y")
    return rows.select(
        "id", "datetime", "step", *[F.col("_x")[i].alias(f"x{i}") for i in (0, 1)], *[F.col("y")[i].alias(f"y{i}") for i in (0, 1)]
    )


@query("legacy_lengths", f"SELECT id, count(DISTINCT datetime) AS n FROM ({windowed(3, 2)}) GROUP BY id", "dirty")
def _(v):
    return frames.legacy_lengths(frames.supervised_legacy(v.dirty, FEATURES, 3, 2, 0, False, D))


@query(
    "xy_split",
    f"""SELECT id, datetime, (step - 1) * 2 + f AS place, CASE f WHEN 0 THEN diff ELSE value END AS x
    FROM ({windowed(4, 2)}), (VALUES (0), (1)) AS t(f) WHERE step BETWEEN 1 AND 3
    UNION ALL SELECT id, datetime, 6 + step - 4, value FROM ({windowed(4, 2)}) WHERE step >= 4
    UNION ALL SELECT id, datetime, 100 + step - 4, diff FROM ({windowed(4, 2)}) WHERE step >= 4""",
    "dirty",
    "x",
    "place",
)
def _(v):
    df = frames.xy_split(supervised(v, 4, 2), FEATURES, 4, 3, 2, 2)
    x = df.select("id", "datetime", F.posexplode("x").alias("place", "x"))
    return x.unionByName(df.select("id", "datetime", F.posexplode("y").alias("place", "x")).withColumn("place", F.col("place") + 100))


@query(
    "mask_future_target",
    f"SELECT id, datetime, step, CASE WHEN step < 4 THEN diff ELSE -99 END AS diff, value FROM ({windowed(4, 2)})",
    "dirty",
    "diff value",
    "step",
)
def _(v):
    return steps(frames.mask_future_target(supervised(v, 4, 2), 4), "steps", "diff", "value")


@query(
    "tensor_3d",
    f"""SELECT id, datetime, step - 1 AS step, CASE WHEN step < 4 THEN diff ELSE -99 END AS x0, value AS x1 FROM ({windowed(4, 2)})
    WHERE step BETWEEN 1 AND 4""",
    "dirty",
    "x0 x1",
    "step",
)
def _(v):
    df = frames.tensor_3d(supervised(v, 4, 2), FEATURES, 4, 3, 2, 1)
    rows = df.select("id", "datetime", F.posexplode("x").alias("step", "_x"))
    return rows.select("id", "datetime", "step", F.col("_x")[0].alias("x0"), F.col("_x")[1].alias("x1"))


@query(
    "past_future_parts",
    f"""SELECT id, datetime, step - 1 AS step, diff AS x0, value AS x1 FROM ({windowed(4, 2)}) WHERE step BETWEEN 1 AND 3
    UNION ALL SELECT id, datetime, 100 + step - 4, value, NULL FROM ({windowed(4, 2)}) WHERE step >= 4""",
    "dirty",
    "x0 x1",
    "step",
)
def _(v):
    df = frames.past_future_parts(frames.tensor_3d(supervised(v, 4, 2), FEATURES, 4, 3, 2, 2), 3, FEATURES)

    def flat(col: str, shift: int, second):
        rows = df.select("id", "datetime", F.posexplode(col).alias("step", "_x"))
        return rows.select("id", "datetime", (F.col("step") + shift).alias("step"), F.col("_x")[0].alias("x0"), second.alias("x1"))

    return flat("past", 0, F.col("_x")[1]).unionByName(flat("future", 100, F.lit(None).cast("double")))


ROLES = [
    Role("id", "categorical", "id"),
    Role("datetime", "date", "time"),
    Role("diff", "real", "target"),
    Role("value", "real", "observed"),
]


def window_sql(source: str = "readings", total: int = 5, encoder: int = 3) -> str:
    return f"""SELECT b.id, b.datetime AS window_start, s.k - b.k AS step, s.datetime AS time, s.diff AS x0, s.value AS x1,
      CASE WHEN s.k - b.k >= {encoder} THEN s.diff END AS output, CASE WHEN s.k - b.k >= {encoder} THEN CAST(1 AS DOUBLE) END AS active
    FROM (SELECT id, datetime, row_number() OVER (PARTITION BY id ORDER BY datetime) AS k, count(*) OVER (PARTITION BY id) AS n FROM {source}) b
    JOIN (SELECT id, datetime, diff, value, row_number() OVER (PARTITION BY id ORDER BY datetime) AS k FROM {source}) s
      ON b.id = s.id AND s.k BETWEEN b.k AND b.k + {total - 1} WHERE b.k + {total - 1} <= b.n"""


def window_rows(df, encoder: int = 3, *keep: str):
    rows = df.select(
        "id", *keep, "window_start", F.posexplode(F.arrays_zip("inputs", "time", "identifier")).alias("step", "_r"), "outputs", "active_entries"
    )
    later = F.col("step") - encoder
    return rows.select(
        F.col("_r.identifier").alias("id"),
        *keep,
        "window_start",
        "step",
        F.col("_r.time").alias("time"),
        F.col("_r.inputs")[0].alias("x0"),
        F.col("_r.inputs")[1].alias("x1"),
        F.when(later >= 0, F.get("outputs", later)).alias("output"),
        F.when(later >= 0, F.get("active_entries", later)).alias("active"),
    )


@query("sliding_windows", window_sql(), "readings", "x0 x1 output active", "step")
def _(v):
    return window_rows(frames.sliding_windows(v.readings, ROLES, 5, 3, s=D))


@query(
    "sampled_windows",
    f"""SELECT * FROM ({window_sql()}) WHERE (id, window_start) IN (SELECT (id, datetime) FROM (
      SELECT id, datetime FROM (SELECT id, datetime, row_number() OVER (PARTITION BY id ORDER BY datetime) AS k,
        count(*) OVER (PARTITION BY id) AS n FROM readings) WHERE k + 4 <= n
      ORDER BY md5(id || '|' || CAST(datetime AS VARCHAR) || '|42') LIMIT 200))""",
    "readings",
    "x0 x1 output active",
    "step",
)
def _(v):
    return window_rows(frames.sampled_windows(v.readings, ROLES, 5, 3, 200, s=D))


@query("sampled_windows_all", window_sql(), "readings", "x0 x1 output active", "step")
def _(v):
    """Asked for more windows than there are, the sample is every window."""
    return window_rows(frames.sampled_windows(v.readings, ROLES, 5, 3, 10**12, s=D))


@query(
    "row_index",
    """SELECT id, datetime, row_number() OVER (PARTITION BY id ORDER BY datetime) - 1 AS b_idx,
      row_number() OVER (ORDER BY id, datetime) - 1 AS index FROM readings""",
    "readings",
)
def _(v):
    return frames.row_index(v.readings.select("id", "datetime"), D)
