"""Forecasts, clusters and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.q_frames import ROLES
from checks.registry import query
from checks.views import D
from heatloom.functions.tables import materialize
from heatloom.operators import clustering, forecast, frames, metrics, regression
from heatloom.operators.profile import building_stats
from heatloom.operators.scaling import apply_scaler, fit_scaler

VALUES = "mse mae rmse nrmse mape avg_diff"
ERROR = """avg((y - y_hat) ** 2) AS mse, avg(abs(y - y_hat)) AS mae,
    avg(abs((y - y_hat) / CASE WHEN y = 0 THEN 2.220446049250313e-16 ELSE y END)) * 100 AS mape"""


def core(by: str = "", source: str = "pred") -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""SELECT {keys}h, mse, mae, sqrt(mse) AS rmse, sqrt(mse) / a AS nrmse, mape, a AS avg_diff, n FROM (
      SELECT *, sum(sy) OVER ({part}) / sum(n) OVER ({part}) AS a FROM (
        SELECT {keys}h, {ERROR}, sum(y) AS sy, count(*) AS n FROM {source} GROUP BY {keys}h))"""


def grouped(by: str = "", source: str = "pred") -> str:
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys}avg(mse) AS mse, avg(mae) AS mae, avg(rmse) AS rmse, avg(nrmse) AS nrmse, avg(mape) AS mape,
      max(avg_diff) AS avg_diff, max(n) AS n_entries FROM ({core(by, source)}) {"GROUP BY " + by if by else ""}"""


def targets(v, n_out: int = 2):
    rows = frames.lag_lead_columns(v.readings.select("id", "datetime", "diff"), 0, n_out, D)
    return frames.drop_incomplete_lags(rows, 0, n_out)


@query(
    "seasonal_naive",
    """SELECT id, datetime, h, CASE h WHEN 0 THEN a ELSE b END AS y, CASE h WHEN 0 THEN p ELSE q END AS y_hat FROM (
      SELECT id, datetime, a, b, coalesce(lag(a, 2) OVER w, 0) AS p, coalesce(lag(b, 2) OVER w, 0) AS q FROM (
        SELECT id, datetime, diff AS a, lead(diff) OVER (PARTITION BY id ORDER BY datetime) AS b FROM readings)
      WHERE b IS NOT NULL WINDOW w AS (PARTITION BY id ORDER BY datetime)), (VALUES (0), (1)) AS t(h)
    WHERE NOT (p = 0 AND q = 0)""",
    "readings",
    "y y_hat",
    "h",
)
def _(v):
    return forecast.seasonal_naive(targets(v), 2, D)


def lagged(v, n_in: int, n_out: int):
    rows = frames.lag_lead_columns(v.readings.select("id", "datetime", "diff"), n_in, n_out, D)
    return materialize(frames.drop_incomplete_lags(rows, n_in, n_out))


@query(
    "linear_forecast",
    """WITH t AS (SELECT * FROM (SELECT id, datetime, lag(diff) OVER w AS x, diff AS a, lead(diff) OVER w AS b FROM readings
        WINDOW w AS (PARTITION BY id ORDER BY datetime)) WHERE x IS NOT NULL AND b IS NOT NULL),
    m AS (SELECT regr_slope(a, x) AS s0, regr_intercept(a, x) AS i0, regr_slope(b, x) AS s1, regr_intercept(b, x) AS i1 FROM t)
    SELECT id, datetime, 0 AS h, a AS y, i0 + s0 * x AS y_hat FROM t, m UNION ALL SELECT id, datetime, 1, b, i1 + s1 * x FROM t, m""",
    "readings",
    "y y_hat",
    "h",
)
def _(v):
    df = lagged(v, 1, 2)
    models = forecast.linear_forecast(df, ["diff(t-1)"], 2)
    return forecast.predict_long(df, models, ["diff(t-1)"], s=D)


_MERGED = """WITH t AS (SELECT * FROM (SELECT id, datetime, source, lag(diff) OVER w AS x, diff AS a, lead(diff) OVER w AS b FROM readings
        WINDOW w AS (PARTITION BY id ORDER BY datetime)) WHERE x IS NOT NULL AND b IS NOT NULL),
    m AS (SELECT {by} regr_slope(a, x) AS s0, regr_intercept(a, x) AS i0, regr_slope(b, x) AS s1, regr_intercept(b, x) AS i1 FROM t {group})
    SELECT id, datetime, {by} 0 AS h, a AS y, i0 + s0 * x AS y_hat FROM t {join} m {using} UNION ALL SELECT id, datetime, {by} 1, b, i1 + s1 * x FROM t {join} m {using}"""


@query("linear_forecast_merged", _MERGED.format(by="", group="", join="CROSS JOIN", using=""), "readings", "y y_hat", "h")
def _(v):
    """The sums of two parts, of which the second comes later, give the model of all rows."""
    df = lagged(v, 1, 2)
    x, ys = [F.col("`diff(t-1)`")], [F.col("diff"), F.col("`diff(t+1)`")]
    early = F.col("datetime") < "2024-01-15"
    parts = [materialize(regression.gram(df.filter(when), x, ys)) for when in (early, ~early)]
    return forecast.predict_long(df, regression.linear_of(regression.merge_grams(parts)), ["diff(t-1)"], s=D)


@query(
    "linear_forecast_by", _MERGED.format(by="source,", group="GROUP BY source", join="JOIN", using="USING (source)"), "readings", "y y_hat", "h"
)
def _(v):
    rows = frames.lag_lead_columns(v.readings.select("id", "datetime", "diff", "source"), 1, 2, D)
    df = materialize(frames.drop_incomplete_lags(rows, 1, 2))
    return forecast.linear_forecast_by(df, df, ["diff(t-1)"], 2, "source", s=D)


@query(
    "batch_predict_quantiles",
    """WITH t AS (SELECT * FROM (SELECT id, datetime, diff AS x, lead(diff, 2) OVER w AS b, lag(diff) OVER w AS p FROM readings
        WINDOW w AS (PARTITION BY id ORDER BY datetime)) WHERE b IS NOT NULL AND p IS NOT NULL)
    SELECT datetime AS forecast_time, id AS identifier, kind, 3 + 2 * x AS "t+0", 10 - x / 2 AS "t+1" FROM t, (VALUES ('p10'), ('p50'), ('p90'), ('targets')) AS k(kind)""",
    "readings",
    "t+0 t+1",
)
def _(v):
    """Targets on a line, which every quantile has to be."""
    x = F.col("inputs")[1][0]
    windows = materialize(frames.sliding_windows(v.readings, ROLES, 4, 2, s=D).withColumn("outputs", F.array(3 + 2 * x, 10 - x / 2)))
    train = windows.select(x.alias("x"), F.col("outputs")[0].alias("diff"), F.col("outputs")[1].alias("diff(t+1)"))
    return forecast.batch_predict(windows, forecast.quantile_forecast(train, ["x"], 2), F.array(x), 2)


@query(
    "quantile_coverage",
    """SELECT kind, count(*) AS n, true AS within FROM (SELECT lag(diff) OVER w AS x FROM readings WINDOW w AS (PARTITION BY id ORDER BY datetime)),
      (VALUES ('p10'), ('p50'), ('p90')) AS k(kind) WHERE x IS NOT NULL GROUP BY kind""",
    "readings",
)
def _(v):
    """Share of targets below each quantile, for noise that grows with the input."""
    df = lagged(v, 1, 1)
    noise = F.pmod(F.xxhash64("id", "datetime"), F.lit(10_000)) / 10_000
    df = materialize(df.withColumn("x", F.col("`diff(t-1)`")).withColumn("diff", 5 + 2 * F.col("x") + (20 + F.abs("x")) * noise * noise))
    model = forecast.quantile_forecast(df, ["x"], 1)
    below = [(F.col("diff") <= p[0]).cast("double") for p in model.predict([F.col("x")])]
    kinds = F.array(*[F.struct(F.lit(n).alias("kind"), F.lit(q).alias("q"), b.alias("b")) for n, q, b in zip(model.names, model.quantiles, below, strict=True)])
    rows = df.select(F.explode(kinds).alias("k")).groupBy("k.kind").agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("k.b") - F.first("k.q")).alias("off"))
    return rows.select("kind", "n", (F.col("off") <= 0.01 + 2 / F.col("n")).alias("within"))


@query(
    "tree_forecast",
    """SELECT id, datetime, h, y, y AS y_hat FROM (SELECT id, datetime, 0 AS h, CAST(CASE source WHEN 's1' THEN 20 ELSE 10 END AS DOUBLE) AS y FROM readings
      UNION ALL SELECT id, datetime, 1, CAST(CASE source WHEN 's1' THEN 4 ELSE 5 END AS DOUBLE) FROM readings)""",
    "readings",
    "y y_hat",
    "h",
)
def _(v):
    """Targets with one step, which a tree with one inner node has to hit."""
    flag = (F.col("source") == "s1").cast("double")
    df = v.readings.select("id", "datetime", flag.alias("flag"), (10 + 10 * flag).alias("diff"), (5 - flag).alias("diff(t+1)"))
    return forecast.predict_long(df, forecast.tree_forecast(df, ["flag"], 2, depth=1), ["flag"], s=D)


@query("tree_forecast_lags")
def _(v):
    df = lagged(v, 3, 2)
    names = [f"diff(t-{i})" for i in (1, 2, 3)]
    return forecast.predict_long(df, forecast.tree_forecast(df, names, 2, depth=4), names, s=D)


@query(
    "batch_predict",
    """WITH t AS (SELECT * FROM (SELECT id, datetime, diff AS x, lead(diff, 1) OVER w AS a, lead(diff, 2) OVER w AS b,
        lag(diff) OVER w AS p FROM readings WINDOW w AS (PARTITION BY id ORDER BY datetime)) WHERE b IS NOT NULL AND p IS NOT NULL),
    m AS (SELECT regr_slope(a, x) AS s0, regr_intercept(a, x) AS i0, regr_slope(b, x) AS s1, regr_intercept(b, x) AS i1 FROM t)
    SELECT datetime AS forecast_time, id AS identifier, 'p50' AS kind, i0 + s0 * x AS "t+0", i1 + s1 * x AS "t+1" FROM t, m
    UNION ALL SELECT datetime, id, 'targets', a, b FROM t""",
    "readings",
    "t+0 t+1",
)
def _(v):
    windows = materialize(frames.sliding_windows(v.readings, ROLES, 4, 2, s=D))
    last = F.array(F.col("inputs")[1][0])
    train = windows.select(last[0].alias("x"), F.col("outputs")[0].alias("diff"), F.col("outputs")[1].alias("diff(t+1)"))
    models = {"p50": forecast.linear_forecast(train, ["x"], 2)}
    return forecast.batch_predict(windows, models, last, 2)


_STATS_OF = """SELECT id, avg(diff) AS a, stddev_samp(diff) AS s, median(diff) AS m, min(diff) AS lo, max(diff) AS hi FROM readings GROUP BY id HAVING count(*) >= 15"""


@query(
    "cluster_buildings",
    f"""SELECT 'rows' AS what, count(*) * 1.0 AS value FROM ({_STATS_OF}) UNION ALL SELECT 'mean', avg(a) FROM ({_STATS_OF})
    UNION ALL SELECT 'labels', least(3, count(DISTINCT (a, s, m, lo, hi))) * 1.0 FROM ({_STATS_OF}) UNION ALL SELECT 'ordered', 1.0""",
    "readings",
    "value",
)
def _(v):
    """What holds for the clusters of real readings: all series are in one, the labels are numbered by the mean of their cluster."""
    rows = materialize(forecast.cluster_buildings(v.readings, 3, s=D))
    means = rows.groupBy("label").agg(F.avg("avg").alias("m")).agg(F.array_sort(F.collect_list(F.struct("label", "m"))).alias("l"))  # one row a cluster
    ordered = F.transform("l", lambda x: x["m"]) == F.array_sort(F.transform("l", lambda x: x["m"]))
    one = rows.agg(F.count(F.lit(1)).cast("double").alias("rows"), F.avg("avg").alias("mean"), F.count_distinct("label").cast("double").alias("labels"))
    return one.unpivot([], ["rows", "mean", "labels"], "what", "value").unionAll(means.select(F.lit("ordered"), ordered.cast("double")))


@query(
    "cluster_features",
    f"""SELECT sum(n) AS n, sum(a) AS s_avg, sum(s) AS s_std, sum(lo) AS s_min, sum(q) AS q, true AS few FROM (
      SELECT 1 AS n, a - avg(a) OVER () AS a, s - avg(s) OVER () AS s, lo - avg(lo) OVER () AS lo,
        (a - avg(a) OVER ()) ** 2 + (s - avg(s) OVER ()) ** 2 + (lo - avg(lo) OVER ()) ** 2 AS q FROM ({_STATS_OF}))""",
    "readings",
    "s_avg s_std s_min q",
    "n",
)
def _(v):
    """Few leaves hold all series: their numbers, sums and squares add up to those of the whole."""
    stats = building_stats(v.readings, D, head=1).filter("len >= 15").select("id", "avg", "std", "min")
    _, leaf = clustering.features(stats, ["avg", "std", "min"], 8)
    sums = [F.sum(c).alias(c) for c in ("n", "s_avg", "s_std", "s_min", "q")]
    return leaf.agg(*sums, (F.count(F.lit(1)) <= 8).alias("few"))


@query(
    "cluster_buildings_levels",
    """SELECT id, CAST(id AS BIGINT) % 3 AS label, avg(x) AS avg, stddev_samp(x) AS std, median(x) AS median, min(x) AS min, max(x) AS max
    FROM (SELECT id, 100000 * (CAST(id AS BIGINT) % 3) + diff AS x FROM readings) GROUP BY id HAVING count(*) >= 15""",
    "readings",
    "avg std median min max",
)
def _(v):
    """Consumption on three levels far apart, which the clusters have to be."""
    return forecast.cluster_buildings(v.readings.withColumn("diff", 100000 * (F.col("id").cast("bigint") % 3) + F.col("diff")), s=D)


@query("cluster_members", "SELECT id, datetime, diff, label FROM readings JOIN labels_of USING (id) WHERE label > 0", "readings labels_of", "diff")
def _(v):
    return forecast.cluster_members(v.readings.select("id", "datetime", "diff"), v.labels_of.filter("label > 0"), D)


@query("cluster_sizes", "SELECT label, count(*) AS n FROM readings JOIN labels_of USING (id) GROUP BY label", "readings labels_of")
def _(v):
    return forecast.cluster_sizes(forecast.cluster_members(v.readings, v.labels_of, D))


# ---- evaluation ------------------------------------------------------------------------------------------------


@query("metrics_core", core(), "pred", VALUES, "h")
def _(v):
    return metrics.metrics_core(v.pred)


@query("metrics_mean_horizon", grouped(), "pred", VALUES)
def _(v):
    return metrics.metrics_mean_horizon(metrics.metrics_core(v.pred))


@query("row_rse", "SELECT id, datetime, sqrt(avg((y - y_hat) ** 2)) AS rse FROM pred GROUP BY 1, 2", "pred", "rse")
def _(v):
    return metrics.row_rse(v.pred, D)


@query("metrics_per_id", grouped("id"), "pred", VALUES)
def _(v):
    return metrics.metrics_per_id(v.pred)


@query(
    "nrse_by_area",
    """SELECT id, datetime, rse, heated_area, rse / nullif(heated_area, 0) AS nrse
    FROM (SELECT id, datetime, sqrt(avg((y - y_hat) ** 2)) AS rse FROM pred GROUP BY 1, 2) LEFT JOIN meta USING (id)""",
    "pred meta",
    "rse heated_area nrse",
)
def _(v):
    return metrics.nrse_by_area(v.pred, v.meta, D)


@query(
    "predictions_by_id",
    """SELECT id, (row_number() OVER (PARTITION BY id, h ORDER BY datetime) - 1) // 16 AS part,
      (row_number() OVER (PARTITION BY id, h ORDER BY datetime) - 1) % 16 AS place, h, y_hat FROM pred""",
    "pred",
    "y_hat",
    "part place h",
)
def _(v):
    rows = metrics.predictions_by_id(v.pred, D).select("id", "part", F.posexplode("predictions").alias("place", "_v"))
    return rows.select("id", "part", "place", F.posexplode("_v").alias("h", "y_hat"))


@query(
    "metrics_per_id_hour",
    """SELECT id, hour, avg(rse) AS rse, count(*) AS n FROM (
      SELECT id, datetime, hour(datetime) AS hour, sqrt(avg((y - y_hat) ** 2)) AS rse FROM pred GROUP BY 1, 2) GROUP BY 1, 2""",
    "pred",
    "rse",
    "hour",
)
def _(v):
    return metrics.metrics_per_id_hour(v.pred, D)


HOURLY_PRED = """(SELECT id, datetime, h, CASE h WHEN 0 THEN a ELSE b END AS y, CASE h WHEN 0 THEN p ELSE q END AS y_hat,
      hour(datetime) AS hour FROM (
      SELECT id, datetime, diff AS a, lead(diff, 1) OVER w AS b, lag(diff, 2) OVER w AS p, lag(diff, 1) OVER w AS q
      FROM hourly WINDOW w AS (PARTITION BY id ORDER BY datetime)), (VALUES (0), (1)) AS t(h) WHERE b IS NOT NULL AND p IS NOT NULL)"""


@query("metrics_per_hour", grouped("hour", HOURLY_PRED), "hourly", VALUES, "hour")
def _(v):
    from checks.views import H

    rows = frames.lag_lead_columns(v.hourly.select("id", "datetime", "diff"), 2, 2, H)
    rows = frames.drop_incomplete_lags(rows, 2, 2)
    c = lambda n: F.col(f"`{n}`")
    pred = forecast.to_long(rows, F.array("diff", c("diff(t+1)")), F.array(c("diff(t-2)"), c("diff(t-1)")), H)
    return metrics.metrics_per_hour(pred)


@query("metrics_per_month", grouped("month", "(SELECT *, month(datetime) AS month FROM pred)"), "pred", VALUES, "month")
def _(v):
    return metrics.metrics_per_month(v.pred)


@query("metrics_per_day", grouped("day", "(SELECT *, day(datetime) AS day FROM pred)"), "pred", VALUES, "day")
def _(v):
    return metrics.metrics_per_day(v.pred)


LEVELS = {"all": [], "id": ["id"], "day": ["day"], "month": ["month"], "label": ["label"]}


@query(
    "error_moments",
    " UNION ALL BY NAME ".join(
        f"SELECT '{name}' AS level, {'NULL' if name == 'all' else f'CAST({name} AS VARCHAR)'} AS key, {', '.join(f'{x} + 1e-8 AS {x}' for x in VALUES.split())}, n_entries FROM ({grouped('' if name == 'all' else name, 'parted')})"
        for name in LEVELS
    ).replace("parted", "(SELECT *, day(datetime) AS day, month(datetime) AS month FROM pred JOIN labels_of USING (id))"),
    "pred labels_of",
    VALUES,
    "n_entries",
)
def _(v):
    """Every level of the evaluation from one table of moments, which two parts of the rows have been merged into.

    Both sides add 1e-8, since sums in another order may end on either side of a rounding half.
    """
    parts = {"day": F.dayofmonth("datetime").cast("bigint"), "month": F.month("datetime").cast("bigint")}
    rows = v.pred.join(v.labels_of.select("id", "label"), "id").withColumns(parts)
    late = F.col("datetime") >= "2024-01-12"
    moments = materialize(metrics.merge_moments([metrics.error_moments(rows.filter(x), LEVELS) for x in (~late, late)]))
    out = None
    for name, by in LEVELS.items():
        key = F.col(by[0]).cast("string") if by else F.lit(None).cast("string")
        table = metrics.metrics_of(moments, name, by).select(F.lit(name).alias("level"), key.alias("key"), *[(F.col(x) + 1e-8).alias(x) for x in VALUES.split()], "n_entries")
        out = table if out is None else out.unionByName(table)
    return out


@query(
    "common_rows",
    """SELECT 'model' AS model, id, datetime, h, y, y_hat FROM pred WHERE day(datetime) % 3 > 0 AND y_hat IS NOT NULL
    UNION ALL SELECT 'baseline', id, datetime, h, y, y_hat / 2 FROM pred WHERE day(datetime) % 3 > 0 AND y_hat IS NOT NULL""",
    "pred",
    "y y_hat",
    "h",
)
def _(v):
    """A baseline without some days leaves those days out for both."""
    some = v.pred.filter(F.dayofmonth("datetime") % 3 > 0).withColumn("y_hat", F.col("y_hat") / 2)
    both = metrics.common_rows({"model": v.pred, "baseline": some}, D)
    return both["model"].withColumn("model", F.lit("model")).unionByName(both["baseline"].withColumn("model", F.lit("baseline")))


_UNPIVOT = "UNPIVOT INCLUDE NULLS ({} FOR metric IN (mse, mae, rmse, nrmse, mape))"


@query(
    "metrics_per_cluster",
    f"""SELECT label, metric, model, baseline FROM (SELECT label, metric, model FROM ({grouped('label', 'joined')}) {_UNPIVOT.format('model')})
    JOIN (SELECT label, metric, baseline FROM ({grouped('label', '(SELECT * REPLACE (y_hat / 2 AS y_hat) FROM joined)')})
      {_UNPIVOT.format('baseline')}) USING (label, metric)""".replace("joined", "(SELECT * FROM pred JOIN labels_of USING (id))"),
    "pred labels_of",
    "model baseline",
)
def _(v):
    half = v.pred.withColumn("y_hat", F.col("y_hat") / 2)
    return metrics.metrics_per_cluster({"model": v.pred, "baseline": half}, v.labels_of, D)


@query(
    "metrics_scaled",
    """SELECT avg(((y - y_hat) / s) ** 2) AS mse_scaled, avg(abs((y - y_hat) / s)) AS mae_scaled
    FROM pred, (SELECT stddev_pop(diff) AS s FROM readings)""",
    "pred",
    "mse_scaled mae_scaled",
)
def _(v):
    params = fit_scaler(v.readings, ["diff"])
    both = params.select(*[F.col(f"diff_{p}").alias(f"{c}_{p}") for c in ("y", "y_hat") for p in ("shift", "scale")])
    return metrics.metrics_scaled(apply_scaler(v.pred, both, ["y", "y_hat"]))


@query(
    "normalize_by_group_mean",
    "SELECT id, datetime, h, y, y_hat / avg(y_hat) OVER (PARTITION BY id, h) AS y_hat FROM pred",
    "pred",
    "y y_hat",
    "h",
)
def _(v):
    return metrics.normalize_by_group_mean(v.pred, D)


def loss(q: float) -> str:
    return f"({q} * greatest(y - y_hat, 0) + {1 - q} * greatest(y_hat - y, 0))"


@query("pinball_loss", f"SELECT *, {loss(0.1)} + {loss(0.5)} + {loss(0.9)} AS loss FROM pred", "pred", "y y_hat loss", "h")
def _(v):
    return metrics.pinball_loss(v.pred, [0.1, 0.5, 0.9])


@query(
    "q_risk",
    " UNION ALL ".join(
        f"SELECT h, 'p{round(q * 100)}' AS quantile, 2 * avg({loss(q)}) / avg(abs(y)) AS q_risk FROM pred GROUP BY h" for q in (0.1, 0.5, 0.9)
    ),
    "pred",
    "q_risk",
    "h",
)
def _(v):
    return metrics.q_risk(v.pred, [0.1, 0.5, 0.9])


_COLS = "mse, mae, rmse, nrmse, mape, avg_diff"


@query(
    "metrics_by_id_table",
    f"""SELECT id AS row, 'id' AS level, {_COLS} FROM ({grouped('id')}) UNION ALL
    SELECT CAST(h AS VARCHAR), 'horizon', {_COLS} FROM ({core()}) UNION ALL SELECT 'mean', 'all', {_COLS} FROM ({grouped()})""",
    "pred",
    VALUES,
)
def _(v):
    return metrics.metrics_by_id_table(v.pred)


@query(
    "box_summary",
    """SELECT id, count(*) AS n, min(rse) AS min, quantile_cont(rse, 0.25) AS q25, quantile_cont(rse, 0.5) AS median,
      quantile_cont(rse, 0.75) AS q75, max(rse) AS max
    FROM (SELECT id, datetime, sqrt(avg((y - y_hat) ** 2)) AS rse FROM pred GROUP BY 1, 2) GROUP BY id""",
    "pred",
    "min q25 median q75 max",
)
def _(v):
    return metrics.box_summary(metrics.row_rse(v.pred, D))


@query(
    "leaderboard",
    f"""SELECT model, rmse, rank() OVER (ORDER BY rmse) AS rank FROM (SELECT 'naive' AS model, rmse FROM ({grouped()})
    UNION ALL SELECT 'half', rmse FROM ({grouped('', '(SELECT * REPLACE (y_hat / 2 AS y_hat) FROM pred)')}))""",
    "pred",
    "rmse",
)
def _(v):
    mean = lambda p: metrics.metrics_mean_horizon(metrics.metrics_core(p))
    half = v.pred.withColumn("y_hat", F.col("y_hat") / 2)
    return metrics.leaderboard({"naive": mean(v.pred), "half": mean(half)}, "rmse")
