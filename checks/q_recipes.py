"""Dataset recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.q_frames import ROLES, window_rows, window_sql
from checks.q_metrics import VALUES, grouped
from checks.registry import query
from checks.views import D, H
from heatloom import Series
from heatloom.plans import evaluation, recipes
from heatloom.schema import COLUMN_ROLES, RunConfig, column_roles

FEATURES = [
    "diff", "typ", "primary_energy", "heated_area", "anzahlwhg", "tavg", "tmin", "tmax",
    "weekend", "holiday", "weekday", "day_of_month", "daily_avg",
]

ENRICHED = """SELECT e.id, e.datetime, diff, dense_rank() OVER (ORDER BY e.typ) - 1 AS typ, primary_energy, heated_area,
      CASE WHEN anzahlwhg = 0 AND e.typ = 'Mehrfamilienhaus' THEN NULL ELSE anzahlwhg END AS anzahlwhg, tavg, tmin, tmax,
      CAST(isodow(e.datetime) > 5 AS BIGINT) AS weekend,
      CAST(EXISTS (SELECT 1 FROM holidays h WHERE h.state = c.state
        AND CAST(e.datetime AS DATE) BETWEEN h."start" AND coalesce(h."end", h."start")) AS BIGINT) AS holiday,
      isodow(e.datetime) AS weekday, day(e.datetime) AS day_of_month, daily_avg, c.state
    FROM (SELECT r.id, r.datetime, r.diff, coalesce(typ, 'Mehrfamilienhaus') AS typ, primary_energy,
        nullif(heated_area, 0) AS heated_area, anzahlwhg, plz, avg(diff) OVER (PARTITION BY r.id) AS daily_avg
      FROM readings r LEFT JOIN meta m ON r.id = m.id) e
    LEFT JOIN weather_daily w ON e.datetime = w.datetime AND e.plz = w.plz LEFT JOIN cities c ON e.plz = c.plz"""


@query(
    "recipe_features",
    f"SELECT * EXCLUDE (state) FROM ({ENRICHED}) WHERE state IS NOT NULL",
    "readings meta weather_daily cities holidays",
    "diff heated_area tavg tmin tmax daily_avg",
    "weekday day_of_month",
)
def _(v):
    return recipes.recipe_features(v.readings.drop("value", "source"), dimensions(v), D, FEATURES)


HOURLY = ENRICHED.replace("tavg, tmin, tmax", "temp, rhum").replace("weather_daily", "weather").replace("FROM readings r", "FROM user_hours r")


@query(
    "recipe_features_hourly",
    f"SELECT * EXCLUDE (state) FROM ({HOURLY}) WHERE state IS NOT NULL",
    "user_hours meta weather cities holidays",
    "diff heated_area temp rhum daily_avg",
    "weekday day_of_month",
)
def _(v):
    dims = recipes.Dimensions(v.meta, v.weather, v.holidays, v.cities)
    names = [c for c in FEATURES if c not in ("tavg", "tmin", "tmax")] + ["temp", "rhum"]
    return recipes.recipe_features(v.user_hours, dims, H, names)


def dimensions(v):
    return recipes.Dimensions(v.meta, v.weather_daily, v.holidays, v.cities)


def training_input(v):
    """Readings with the columns the training recipe needs."""
    from heatloom.operators import joins, rows

    df = joins.join_meta(v.readings.select("id", "datetime", "diff"), v.meta.select("id", "primary_energy", "heated_area"), "id")
    return rows.calendar_parts(df, ["weekday"])


CONFIG = RunConfig(
    feature_list=("diff", "primary_energy", "heated_area", "weekday"),
    n_in=2, n_out=2, n_future=2, lag_in=2, lag_out=2, train_per=0.4,
)

KINDS = ("district heating", "gas", "oil")
FLAGS = ", ".join(f"CAST(primary_energy = '{k}' AS DOUBLE) AS \"primary_energy_{k}\"" for k in KINDS)
TRAINING = f"""SELECT id, datetime, diff, "diff(t-1)", "diff(t-2)", "diff(t+1)", heated_area, {FLAGS},
      sin(2 * pi() * isodow(datetime) / 7) AS weekday_sin, cos(2 * pi() * isodow(datetime) / 7) AS weekday_cos
    FROM (SELECT r.id, datetime, diff, lag(diff, 1) OVER w AS "diff(t-1)", lag(diff, 2) OVER w AS "diff(t-2)",
        lead(diff, 1) OVER w AS "diff(t+1)", heated_area, primary_energy
      FROM readings r LEFT JOIN meta m ON r.id = m.id WINDOW w AS (PARTITION BY r.id ORDER BY datetime))
    WHERE "diff(t-2)" IS NOT NULL AND "diff(t+1)" IS NOT NULL AND heated_area IS NOT NULL AND primary_energy IS NOT NULL"""
NUMBERS = "diff diff(t-1) diff(t-2) diff(t+1) heated_area weekday_sin weekday_cos"


@query("recipe_training", TRAINING, "readings meta", NUMBERS)
def _(v):
    return recipes.recipe_training(training_input(v), CONFIG, D)[0]


PARTS = """SELECT *, CASE WHEN i <= floor(n * CAST(0.4 AS DOUBLE)) THEN 'train'
      WHEN i <= floor(n * ((1 - CAST(0.4 AS DOUBLE)) / 2 + CAST(0.4 AS DOUBLE))) THEN 'test' ELSE 'val' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY datetime) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM {})
    WHERE least(floor(n * CAST(0.4 AS DOUBLE)) + 1, n) > {}
      AND least(floor(n * ((1 - CAST(0.4 AS DOUBLE)) / 2 + CAST(0.4 AS DOUBLE))), n - 1) - floor(n * CAST(0.4 AS DOUBLE)) > {}
      AND n - 1 - floor(n * ((1 - CAST(0.4 AS DOUBLE)) / 2 + CAST(0.4 AS DOUBLE))) > {}"""


def parts(source: str, limit: int) -> str:
    return PARTS.format(source, limit, limit, limit)


def z(col: str, over: str = "") -> str:
    part = f"FILTER (split = 'train') OVER ({over})"
    return f"({col} - avg({col}) {part}) / coalesce(nullif(stddev_pop({col}) {part}, 0), 1) AS {col}"


@query(
    "recipe_prepare",
    f"SELECT * EXCLUDE (i, n) REPLACE ({z('diff', 'PARTITION BY id')}, {z('heated_area')}) FROM ({parts(f'({TRAINING})', 4)})",
    "readings meta",
    NUMBERS,
)
def _(v):
    return recipes.recipe_prepare(training_input(v), CONFIG, D)[0]


LAGGED = ", ".join([f'lag(diff, {i}) OVER w AS "diff(t-{i})"' for i in range(1, 73)] + [f'lead(diff, {i}) OVER w AS "diff(t+{i})"' for i in range(1, 72)])
LAGGED_NAMES = [f"diff(t-{i})" for i in range(1, 73)] + [f"diff(t+{i})" for i in range(1, 72)]


@query(
    "recipe_prepare_hourly",
    f"""SELECT * EXCLUDE (i, n) REPLACE ({z('diff', 'PARTITION BY id')}) FROM ({parts(f"""(SELECT id, datetime, diff,
      sin(2 * pi() * isodow(datetime) / 7) AS weekday_sin, cos(2 * pi() * isodow(datetime) / 7) AS weekday_cos, * EXCLUDE (id, datetime, diff)
      FROM (SELECT id, datetime, diff, {LAGGED} FROM hourly WINDOW w AS (PARTITION BY id ORDER BY datetime))
      WHERE "diff(t-72)" IS NOT NULL AND "diff(t+71)" IS NOT NULL)""", 144)})""",
    "hourly",
    " ".join(["diff", *LAGGED_NAMES, "weekday_sin", "weekday_cos"]),
)
def _(v):
    from heatloom.operators import rows

    config = RunConfig(res="hour", feature_list=("diff", "weekday"), n_in=72, n_out=24, n_future=24, train_per=0.4)
    return recipes.recipe_prepare(rows.calendar_parts(v.hourly.select("id", "datetime", "diff"), ["weekday"]), config, H)[0]


PREDICTED = f"""t AS ({parts(f'({TRAINING})', 4)}),
    p AS (SELECT id, avg(diff) AS m, coalesce(nullif(stddev_pop(diff), 0), 1) AS s FROM t WHERE split = 'train' GROUP BY id),
    k AS (SELECT split, id, datetime, m, s, diff AS a, "diff(t+1)" AS b, ("diff(t-1)" - m) / s AS x FROM t JOIN p USING (id)),
    r AS (SELECT regr_slope((a - m) / s, x) AS s0, regr_intercept((a - m) / s, x) AS i0, regr_slope((b - m) / s, x) AS s1,
      regr_intercept((b - m) / s, x) AS i1 FROM k WHERE split = 'train'),
    linear AS (SELECT id, datetime, h, CASE h WHEN 0 THEN a ELSE b END AS y, CASE h WHEN 0 THEN i0 + s0 * x ELSE i1 + s1 * x END * s + m AS y_hat
      FROM k, r, (VALUES (0), (1)) AS v(h) WHERE split = 'test'),
    naive AS (SELECT id, datetime, h, CASE h WHEN 0 THEN a ELSE b END AS y, CASE h WHEN 0 THEN p ELSE q END AS y_hat FROM (
        SELECT id, datetime, a, b, coalesce(lag(a, 2) OVER w, 0) AS p, coalesce(lag(b, 2) OVER w, 0) AS q FROM k WHERE split = 'test'
        WINDOW w AS (PARTITION BY id ORDER BY datetime)), (VALUES (0), (1)) AS v(h) WHERE NOT (p = 0 AND q = 0))"""


def predicted(v):
    return evaluation.recipe_evaluate(training_input(v), CONFIG, D, ["diff(t-1)"])


@query(
    "recipe_evaluate",
    f"WITH {PREDICTED} SELECT 'linear' AS model, * FROM ({grouped('id', 'linear')}) UNION ALL SELECT 'naive', * FROM ({grouped('id', 'naive')})",
    "readings meta",
    VALUES,
)
def _(v):
    return evaluation.errors_per_id(predicted(v), D)


def by_cluster(model: str) -> str:
    source = f"(SELECT * FROM {model} JOIN labels_of USING (id))"
    names = VALUES.replace(" avg_diff", "").replace(" ", ", ")
    return f"SELECT label, metric, v AS {model} FROM ({grouped('label', source)}) UNPIVOT INCLUDE NULLS (v FOR metric IN ({names}))"


@query(
    "recipe_evaluate_clusters",
    f"WITH {PREDICTED} SELECT label, metric, linear, naive FROM ({by_cluster('linear')}) FULL JOIN ({by_cluster('naive')}) USING (label, metric)",
    "readings meta labels_of",
    "linear naive",
)
def _(v):
    return evaluation.errors_per_cluster(predicted(v), v.labels_of, D)


@query(
    "recipe_windowing",
    f"""WITH scaled AS (SELECT id, datetime, split, {z('diff', 'PARTITION BY id')}, {z('value')} FROM ({parts('readings', 4)})),
    w AS (SELECT split || '|' || id AS id, datetime, diff, value FROM scaled)
    SELECT split_part(id, '|', 2) AS id, split_part(id, '|', 1) AS split, * EXCLUDE (id) FROM ({window_sql('w', 4, 2)})""",
    "readings",
    "x0 x1 output active",
    "step",
)
def _(v):
    out = recipes.recipe_windowing(v.readings, ROLES, 4, 2, D, train_per=0.4)
    return window_rows(out, 2, "split")


VOLATILITY = """SELECT Symbol, date, rv5_ss, open_to_close, isodow(date) - 1 AS day_of_week, day(date) AS day_of_month,
      weekofyear(date) AS week_of_year, month(date) AS month, year(date) AS year,
      date_diff('day', TIMESTAMP '2000-01-03', date) AS days_from_start,
      last_value(ln(nullif(rv5_ss, 0)) IGNORE NULLS) OVER (PARTITION BY Symbol ORDER BY date) AS log_vol,
      CASE WHEN CAST(substr(Symbol, 8) AS INTEGER) % 2 = 0 THEN 'EMEA' ELSE 'AMER' END AS Region, Symbol AS categorical_id FROM volatility"""
REGIONS = {f"NATION_{i}": "EMEA" if i % 2 == 0 else "AMER" for i in range(25)}


@query(
    "recipe_volatility", VOLATILITY, "volatility", "rv5_ss open_to_close log_vol", "day_of_week day_of_month week_of_year month year"
)
def _(v):
    return recipes.recipe_volatility(v.volatility, REGIONS)


@query(
    "column_roles",
    f"""SELECT Symbol, date, log_vol, open_to_close, days_from_start, day_of_week, day_of_month, week_of_year, month, Region
    FROM ({VOLATILITY})""",
    "volatility",
    "open_to_close log_vol",
    "day_of_week day_of_month week_of_year month",
)
def _(v):
    """The columns a declared dataset is made of, in model order."""
    names = [r.name for r in column_roles(COLUMN_ROLES["volatility"])]
    return recipes.recipe_volatility(v.volatility, REGIONS).select(*names)


def coded(col: str) -> str:
    """Position of a category among those of train in alphabetical order."""
    return f"(SELECT count(*) FROM (SELECT DISTINCT CAST({col} AS VARCHAR) AS c FROM t WHERE split = 'train') WHERE c < CAST(t.{col} AS VARCHAR)) AS {col}"


def part_windows(source: str, id_col: str, time: str, inputs: list[str], total: int, encoder: int) -> str:
    values = ", ".join(f"CAST(s.{c} AS DOUBLE) AS x{i}" for i, c in enumerate(inputs))
    rows = f"(SELECT *, row_number() OVER p AS k, count(*) OVER (PARTITION BY split, {id_col}) AS n FROM {source} WINDOW p AS (PARTITION BY split, {id_col} ORDER BY {time}))"
    return f"""SELECT b.{id_col} AS id, b.split, b.{time} AS window_start, s.k - b.k AS step, s.{time} AS time, {values},
      CASE WHEN s.k - b.k >= {encoder} THEN s.{inputs[0]} END AS output
    FROM {rows} b JOIN {rows} s ON b.split = s.split AND b.{id_col} = s.{id_col} AND s.k BETWEEN b.k AND b.k + {total - 1} WHERE b.k + {total - 1} <= b.n"""


def part_rows(df, id_col: str, n: int, encoder: int):
    rows = df.select(F.col(id_col).alias("id"), "split", "window_start", "outputs", F.posexplode(F.arrays_zip("inputs", "time")).alias("step", "_r"))
    later = F.col("step") - encoder
    return rows.select(
        "id", "split", "window_start", "step", F.col("_r.time").alias("time"), *[F.col("_r.inputs")[i].alias(f"x{i}") for i in range(n)],
        F.when(later >= 0, F.get("outputs", later)).alias("output"),
    )


VOL_REAL, VOL_CAT = ["log_vol", "open_to_close", "days_from_start"], ["day_of_week", "day_of_month", "week_of_year", "month", "Region"]


@query(
    "recipe_volatility_windows",
    f"""WITH t AS (SELECT *, CASE WHEN year < 1999 THEN 'train' WHEN year < 2000 THEN 'val' ELSE 'test' END AS split
        FROM ({VOLATILITY}) WHERE year < 2000 OR date < TIMESTAMP '2000-07-01'),
    c AS (SELECT Symbol, date, split, {", ".join(z(x) for x in VOL_REAL)}, {", ".join(coded(x) for x in VOL_CAT)} FROM t)
    {part_windows('c', 'Symbol', 'date', VOL_REAL + VOL_CAT, 4, 2)}""",
    "volatility",
    " ".join([f"x{i}" for i in range(8)] + ["output"]),
    "step",
)
def _(v):
    s = Series("day", id="Symbol", time="date", points=365, chunk=64)
    out = recipes.recipe_volatility_windows(recipes.recipe_volatility(v.volatility, REGIONS), 4, 2, 1999, 2000, "2000-06-30", s)
    return part_rows(out, "Symbol", 8, 2)


ELECTRICITY = """WITH h AS (SELECT id, date_trunc('hour', ts) AS date, nullif(avg(usage), 0) AS p FROM quarter_hours GROUP BY 1, 2),
    g AS (SELECT id, unnest(generate_series(min(date), max(date), INTERVAL 1 HOUR)) AS date FROM h GROUP BY id),
    t AS (SELECT id, date, coalesce(p, 0) AS power_usage, hour(date) AS hour, day(date) AS day, isodow(date) - 1 AS day_of_week,
      month(date) AS month, date_diff('hour', (SELECT min(date) FROM h), date) AS t FROM g LEFT JOIN h USING (id, date))
    SELECT *, t AS hours_from_start, t // 24 AS days_from_start, id AS categorical_id, day_of_week AS categorical_day_of_week,
      hour AS categorical_hour FROM t WHERE t // 24 BETWEEN 5 AND 20"""


@query(
    "recipe_electricity",
    ELECTRICITY,
    "quarter_hours",
    "power_usage",
    "hour day day_of_week month categorical_day_of_week categorical_hour days_from_start",
)
def _(v):
    return recipes.recipe_electricity(v.electricity_wide, "ts", 5, 20)


ELE_REAL = ["power_usage", "hour", "day_of_week", "hours_from_start"]


@query(
    "recipe_electricity_windows",
    f"""WITH e AS ({ELECTRICITY}),
    t AS (SELECT *, 'train' AS split FROM e WHERE days_from_start < 12
      UNION ALL SELECT *, 'val' FROM e WHERE days_from_start >= 10 AND days_from_start < 16 UNION ALL SELECT *, 'test' FROM e WHERE days_from_start >= 14),
    c AS (SELECT id, date, split, {", ".join(z(x, 'PARTITION BY id') for x in ELE_REAL)}, {coded('categorical_id')},
      count(*) FILTER (split = 'train') OVER (PARTITION BY id) AS n_train FROM t)
    {part_windows('(SELECT * FROM c WHERE n_train >= 6)', 'id', 'date', [*ELE_REAL, 'categorical_id'], 6, 4)}""",
    "quarter_hours",
    "x0 x1 x2 x3 x4 output",
    "step",
)
def _(v):
    rows = recipes.recipe_electricity(v.electricity_wide, "ts", 5, 20)
    out = recipes.recipe_electricity_windows(rows, 6, 4, 12, 16, 2, Series("hour", time="date", points=48, chunk=64))
    return part_rows(out, "id", 5, 4)


@query(
    "recipe_traffic",
    """SELECT *, id || '_' || lpad(CAST(sensor_day AS VARCHAR), 3, '0') || '_' || lpad(CAST(time_on_day AS VARCHAR), 3, '0') AS key,
      id AS categorical_id, day_of_week AS categorical_day_of_week, time_on_day AS categorical_time_on_day FROM (
      SELECT *, sensor_day * 24 + time_on_day AS hours_from_start,
        lag("values") OVER (PARTITION BY id ORDER BY sensor_day, time_on_day) AS prev_values,
        lead("values") OVER (PARTITION BY id ORDER BY sensor_day, time_on_day) AS next_values
      FROM (SELECT ("row" + 1) * 100 AS id, 29 - position AS sensor_day, slot // 6 AS time_on_day, (position * 3) % 7 + 1 AS day_of_week,
          avg(value) AS "values" FROM matrix GROUP BY 1, 2, 3, 4))
    WHERE prev_values IS NOT NULL AND next_values IS NOT NULL AND sensor_day <= 25""",
    "matrix",
    "values prev_values next_values",
    "id sensor_day time_on_day day_of_week hours_from_start categorical_id categorical_day_of_week categorical_time_on_day",
)
def _(v):
    return recipes.recipe_traffic(v.traffic_lines, v.perm, v.weekdays, v.stations, last_day=25)


@query(
    "recipe_retail",
    """WITH sold AS (SELECT *, store_nbr || '_' || item_nbr AS traj_id FROM sales
        WHERE date >= TIMESTAMP '1997-01-01' AND date < TIMESTAMP '1998-06-01'),
    s AS (SELECT * FROM sold
      QUALIFY min(unit_sales) OVER (PARTITION BY traj_id) >= 0),
    g AS (SELECT *, unnest(generate_series(date, coalesce(n - INTERVAL 1 DAY, date), INTERVAL 1 DAY)) AS day
      FROM (SELECT *, lead(date) OVER (PARTITION BY traj_id ORDER BY date) AS n FROM s)),
    r AS (SELECT traj_id, day AS date, store_nbr, item_nbr, onpromotion, CASE WHEN day = date THEN unit_sales END AS unit_sales,
      CASE WHEN day = date THEN 1 ELSE 0 END AS open, CASE WHEN day = date THEN ln(unit_sales) END AS log_sales FROM g)
    SELECT r.*, traj_id || '_' || strftime(r.date, '%Y-%m-%d') AS unique_id, coalesce(o.oil, -1) AS oil, city, state, family, class,
      coalesce(t.transactions, -1) AS transactions, isodow(r.date) - 1 AS day_of_week, day(r.date) AS day_of_month, month(r.date) AS month,
      coalesce(nh.d, '') AS national_hol, coalesce(rh.d, '') AS regional_hol, coalesce(lh.d, '') AS local_hol
    FROM r LEFT JOIN (SELECT date, last_value(oil IGNORE NULLS) OVER (ORDER BY date) AS oil FROM (SELECT DISTINCT date FROM sold)
        LEFT JOIN oil USING (date)) o ON r.date = o.date
    LEFT JOIN stores USING (store_nbr) LEFT JOIN items USING (item_nbr)
    LEFT JOIN transactions t ON r.date = t.date AND r.store_nbr = t.store_nbr
    LEFT JOIN (SELECT date, min(description) AS d FROM hol_events WHERE NOT transferred AND locale = 'National' GROUP BY 1) nh ON r.date = nh.date
    LEFT JOIN (SELECT date, locale_name, min(description) AS d FROM hol_events WHERE NOT transferred AND locale = 'Regional' GROUP BY 1, 2) rh
      ON r.date = rh.date AND rh.locale_name = state
    LEFT JOIN (SELECT date, locale_name, min(description) AS d FROM hol_events WHERE NOT transferred AND locale = 'Local' GROUP BY 1, 2) lh
      ON r.date = lh.date AND lh.locale_name = city""",
    "sales stores items oil transactions hol_events",
    "unit_sales log_sales oil",
    "onpromotion open class transactions day_of_week day_of_month month",
)
def _(v):
    tables = recipes.RetailTables(v.stores, v.items, v.oil, v.transactions, v.hol_events)
    return recipes.recipe_retail(v.sales, tables, "1997-01-01", "1998-06-01")
