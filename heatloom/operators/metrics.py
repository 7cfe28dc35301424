"""Error metrics of long prediction frames ``(id, datetime, h, y, y_hat)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatloom.functions.order import quantiles
from heatloom.functions.series import DAILY, Series
from heatloom.functions.skew import spread_join
from heatloom.functions.tables import materialize

EPS = 2.220446049250313e-16
NAMES = ("mse", "mae", "rmse", "nrmse", "mape")


def metrics_core(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """MSE, MAE, RMSE, NRMSE and MAPE per group and horizon, and the mean target of the group.

    NRMSE divides by the mean target over all horizons of the group. In MAPE a target of zero is replaced by the
    machine epsilon.
    """
    by = list(by)
    error = F.col("y") - F.col("y_hat")
    safe = F.when(F.col("y") == 0, F.lit(EPS)).otherwise(F.col("y"))
    rows = pred.groupBy(*by, "h").agg(
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.avg(F.abs(error / safe)) * 100).alias("mape"),
        F.sum("y").alias("_sum"),
        F.count("y").alias("_n"),
    )
    group = Window.partitionBy(*(by or [F.lit(0)]))  # one row per horizon of a group
    mean = F.sum("_sum").over(group) / F.sum("_n").over(group)
    rows = rows.withColumns({"avg_diff": mean, "rmse": F.sqrt("mse"), "n": F.col("_n")})
    return rows.withColumn("nrmse", F.col("rmse") / F.col("avg_diff")).drop("_sum", "_n")


def metrics_mean_horizon(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of each metric over the horizons."""
    return metrics.groupBy(*by).agg(
        *[F.avg(n).alias(n) for n in NAMES], F.max("avg_diff").alias("avg_diff"), F.max("n").alias("n_entries")
    )


def row_rse(pred: DataFrame, s: Series = DAILY, keep: Sequence[str] = ()) -> DataFrame:
    """Root of the mean squared error over the horizons of each sample."""
    error = F.col("y") - F.col("y_hat")
    return pred.groupBy(s.id, s.time, *keep).agg(F.sqrt(F.avg(error * error)).alias("rse"))


def _grouped(pred: DataFrame, by: Sequence[str]) -> DataFrame:
    return metrics_mean_horizon(metrics_core(pred, by), by)


def metrics_per_id(pred: DataFrame, id_col: str = "id") -> DataFrame:
    """Metrics of each series averaged over the horizons, with its mean target."""
    return _grouped(pred, [id_col])


def nrse_by_area(pred: DataFrame, meta: DataFrame, s: Series = DAILY) -> DataFrame:
    """Sample errors and the same divided by the heated area of the building."""
    rse = spread_join(row_rse(pred, s), meta.select(s.id, "heated_area"), s.id, by=s.time)
    return rse.withColumn("nrse", F.col("rse") / F.nullif(F.col("heated_area"), F.lit(0.0)))


def predictions_by_id(pred: DataFrame, s: Series = DAILY) -> DataFrame:
    """Predictions of each series in time order, as one list per series and run of ``s.chunk`` samples."""
    samples = pred.groupBy(s.id, s.time).agg(F.array_sort(F.collect_list(F.struct("h", "y_hat"))).alias("_h"))
    rows = s.numbered(samples).withColumn("part", F.floor(F.col("_pos") / s.chunk))
    vector = F.transform("_h", lambda x: x["y_hat"]).alias("v")
    rows = rows.groupBy(s.id, "part").agg(F.array_sort(F.collect_list(F.struct("_pos", vector))).alias("_p"))
    return rows.select(s.id, "part", F.transform("_p", lambda x: x["v"]).alias("predictions"))


def metrics_per_id_hour(pred: DataFrame, s: Series = DAILY) -> DataFrame:
    """Sample errors per series and hour of the day: mean and number."""
    rse = row_rse(pred, s).withColumn("hour", F.hour(s.time).cast("bigint"))
    return rse.groupBy(s.id, "hour").agg(F.avg("rse").alias("rse"), F.count(F.lit(1)).alias("n"))


def _by_part(pred: DataFrame, part: Column, name: str) -> DataFrame:
    return _grouped(pred.withColumn(name, part.cast("bigint")), [name])


def metrics_per_hour(pred: DataFrame, time: str = "datetime") -> DataFrame:
    """Metrics by hour of the day, 0 to 23."""
    return _by_part(pred, F.hour(time), "hour")


def metrics_per_month(pred: DataFrame, time: str = "datetime") -> DataFrame:
    """Metrics by month with the number of samples; months without any are left out."""
    return _by_part(pred, F.month(time), "month")


def metrics_per_day(pred: DataFrame, time: str = "datetime") -> DataFrame:
    """Metrics by day of the month."""
    return _by_part(pred, F.dayofmonth(time), "day")


def _tagged(preds: dict[str, DataFrame], s: Series, name: str = "model") -> DataFrame:
    out = None
    for model, pred in preds.items():
        rows = pred.select(s.id, s.time, "h", "y", "y_hat", F.lit(model).alias(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def metrics_per_cluster(preds: dict[str, DataFrame], labels: DataFrame, s: Series = DAILY) -> DataFrame:
    """Metrics per cluster of several models side by side, one row per cluster and metric, from one aggregate over all of them."""
    rows = spread_join(_tagged(preds, s, "_model"), labels.select(s.id, "label"), s.id, "inner", by=[s.time, "h"])
    found = _grouped(rows, ["label", "_model"])
    values = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in NAMES])
    long = found.select("label", "_model", F.inline(values))
    return long.groupBy("label", "metric").agg(*[F.max(F.when(F.col("_model") == m, F.col("v"))).alias(m) for m in preds])


def common_rows(preds: dict[str, DataFrame], s: Series = DAILY) -> dict[str, DataFrame]:
    """The predictions of each model for the rows (series, time, horizon) that all models predict, so that errors can be compared.

    All models are brought together by one shuffle and stored once.
    """
    names = list(preds)
    values = [F.max(F.when(F.col("model") == m, F.col("y_hat"))).alias(f"_p{i}") for i, m in enumerate(names)]
    both = _tagged(preds, s).groupBy(s.id, s.time, "h").agg(F.max("y").alias("y"), *values).dropna(subset=[f"_p{i}" for i in range(len(names))])
    both = materialize(both)
    return {m: both.select(s.id, s.time, "h", "y", F.col(f"_p{i}").alias("y_hat")) for i, m in enumerate(names)}


#: Columns of a table of moments that add up.
MOMENTS = ["n", "n_errors", "sum_y", "sum_square", "sum_abs", "sum_share"]


def error_moments(pred: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Sums of errors per horizon for the groups of every level, from one scan and one shuffle (grouping sets).

    ``levels`` names lists of columns, an empty one for everything. Rows have their ``level``, its columns (others are null), ``h`` and ``MOMENTS``.
    Tables of the same levels are merged by adding, so metrics over later data need the new rows only.
    """
    cols = list(dict.fromkeys(c for level in levels.values() for c in level))
    error = F.col("y") - F.col("y_hat")
    safe = F.when(F.col("y") == 0, F.lit(EPS)).otherwise(F.col("y"))
    keys = [*cols, "h"]
    sums = [F.count("y"), F.count(error), F.sum("y"), F.sum(error * error), F.sum(F.abs(error)), F.sum(F.abs(error / safe))]
    rows = pred.groupingSets([[*level, "h"] for level in levels.values()], *keys).agg(
        F.grouping_id().alias("_g"), *[x.alias(name) for x, name in zip(sums, MOMENTS, strict=True)]
    )
    number = {name: sum(1 << (len(keys) - 1 - i) for i, c in enumerate(keys) if c not in (*level, "h")) for name, level in levels.items()}
    level = F.create_map(*[F.lit(x) for name, g in number.items() for x in (g, name)])[F.col("_g").cast("int")]
    return rows.select(level.alias("level"), *keys, *MOMENTS)


def merge_moments(tables: Sequence[DataFrame]) -> DataFrame:
    """One table of moments of the rows of several."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    keys = [c for c in out.columns if c not in MOMENTS]
    return out.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in MOMENTS])


def metrics_of(moments: DataFrame, level: str, by: Sequence[str]) -> DataFrame:
    """The metrics of one level, averaged over the horizons, from its moments; as ``metrics_per_id`` and its like have them."""
    by = list(by)
    rows = moments.filter(F.col("level") == level)
    n = F.col("n_errors")
    rows = rows.select(
        *by, "h", "n", "sum_y", (F.col("sum_square") / n).alias("mse"), (F.col("sum_abs") / n).alias("mae"), (F.col("sum_share") / n * 100).alias("mape")
    )
    group = Window.partitionBy(*(by or [F.lit(0)]))  # one row per horizon of a group
    mean = F.sum("sum_y").over(group) / F.sum("n").over(group)
    rows = rows.withColumns({"avg_diff": mean, "rmse": F.sqrt("mse")}).withColumn("nrmse", F.col("rmse") / F.col("avg_diff"))
    return metrics_mean_horizon(rows, by)


def metrics_scaled(pred_scaled: DataFrame) -> DataFrame:
    """MSE and MAE over all horizons in scaled units, before the inverse transform."""
    error = F.col("y") - F.col("y_hat")
    return pred_scaled.agg(F.avg(error * error).alias("mse_scaled"), F.avg(F.abs(error)).alias("mae_scaled"))


def normalize_by_group_mean(pred: DataFrame, s: Series = DAILY, col: str = "y_hat") -> DataFrame:
    """Each prediction over the mean prediction of its series and horizon; a mean of zero is an error."""
    means = pred.groupBy(s.id, "h").agg(F.avg(col).alias("_mean"))
    rows = spread_join(pred, means, [s.id, "h"], "inner", by=s.time)
    zero = F.raise_error(F.concat(F.lit("mean prediction is zero for "), F.col(s.id))).cast("double")
    return rows.withColumn(col, F.when(F.col("_mean") != 0, F.col(col) / F.col("_mean")).otherwise(zero)).drop("_mean")


def _pinball(q: float) -> Column:
    if not 0 <= q <= 1:
        raise ValueError(f"quantile {q} is outside [0, 1]")
    under = F.greatest(F.col("y") - F.col("y_hat"), F.lit(0.0))
    over = F.greatest(F.col("y_hat") - F.col("y"), F.lit(0.0))
    return F.lit(float(q)) * under + F.lit(1 - float(q)) * over


def pinball_loss(pred: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """Quantile loss of each row, summed over the quantiles."""
    total = _pinball(quantiles[0])
    for q in quantiles[1:]:
        total = total + _pinball(q)
    return pred.withColumn("loss", total)


def q_risk(pred: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """Twice the mean quantile loss over the mean absolute target, per horizon and quantile."""
    parts = [(2 * F.avg(_pinball(q)) / F.avg(F.abs("y"))).alias(f"p{round(q * 100)}") for q in quantiles]
    names = [f"p{round(q * 100)}" for q in quantiles]
    return pred.groupBy("h").agg(*parts).unpivot(["h"], names, "quantile", "q_risk")


def metrics_by_id_table(pred: DataFrame, id_col: str = "id") -> DataFrame:
    """Metrics per series, followed by those of all series per horizon and their mean."""
    cols = [*NAMES, "avg_diff"]
    per_id = metrics_per_id(pred, id_col).select(F.col(id_col).alias("row"), F.lit("id").alias("level"), *cols)
    core = metrics_core(pred)
    per_h = core.select(F.col("h").cast("string").alias("row"), F.lit("horizon").alias("level"), *cols)
    mean = metrics_mean_horizon(core).select(F.lit("mean").alias("row"), F.lit("all").alias("level"), *cols)
    return per_id.unionByName(per_h).unionByName(mean)


def box_summary(rse: DataFrame, id_col: str = "id", col: str = "rse") -> DataFrame:
    """Five-number summary of the sample errors of each series."""
    probs = {"min": 0.0, "q25": 0.25, "median": 0.5, "q75": 0.75, "max": 1.0}
    return quantiles(rse, id_col, col, probs)


def leaderboard(tables: dict[str, DataFrame], metric: str) -> DataFrame:
    """One metric across several models, best first."""
    out = None
    for name, table in tables.items():
        row = table.select(F.lit(name).alias("model"), F.col(metric).alias(metric))
        out = row if out is None else out.unionByName(row)
    w = Window.partitionBy(F.lit(0)).orderBy(metric)  # one row per model
    return out.withColumn("rank", F.rank().over(w).cast("bigint"))
