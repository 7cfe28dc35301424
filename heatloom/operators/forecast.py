"""Forecasts and clusters: the seasonal baseline, least squares, quantile regression, spark.ml trees, Ward clusters."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.functions.series import DAILY, Series
from heatloom.functions.skew import spread_join
from heatloom.functions.tables import materialize
from heatloom.operators.clustering import ward_clusters
from heatloom.operators.frames import ahead
from heatloom.operators.profile import building_stats
from heatloom.operators.regression import Linear, Quantiles, fit_groups, fit_linear, fit_quantiles, gram, predict_groups
from heatloom.schema import N_CLUSTERS


def to_long(df: DataFrame, y: Column, y_hat: Column, s: Series = DAILY, keep: Sequence[str] = ()) -> DataFrame:
    """One row per sample and horizon from arrays of targets and predictions."""
    rows = df.withColumns({"_y": y, "_p": y_hat})
    pairs = F.arrays_zip("_y", "_p")
    rows = rows.select(s.id, s.time, *keep, F.posexplode(pairs).alias("h", "_pair"))
    return rows.select(
        s.id, s.time, *keep, F.col("h").cast("bigint").alias("h"), F.col("_pair._y").alias("y"), F.col("_pair._p").alias("y_hat")
    )


def seasonal_naive(df: DataFrame, n_out: int, s: Series = DAILY, target: str = "diff") -> DataFrame:
    """Predict the target vector of ``n_out`` rows earlier; long frame of ``h, y, y_hat``.

    Input rows hold the targets ``diff``, ``diff(t+1)`` … in columns. Without such an earlier row the prediction is
    zero, and samples whose whole prediction is zero are left out.
    """
    names = [ahead(target, i) for i in range(n_out)]
    y = F.array(*[F.col(f"`{c}`") for c in names])
    rows = df.select(s.id, s.time, y.alias("_target"))
    rows = s.neighbours(rows, n_out, 0, lambda w: {"_earlier": F.lag("_target", n_out).over(w)})
    zero = F.array(*[F.lit(0.0)] * n_out)
    rows = rows.withColumn("_earlier", F.coalesce("_earlier", zero))
    rows = rows.filter(~F.forall("_earlier", lambda v: F.coalesce(v == 0, F.lit(False))))
    return to_long(rows, F.col("_target"), F.col("_earlier"), s)


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.array(*[F.col(f"`{c}`").cast("double") for c in features])))


#: Fits that run at the same time over one stored table.
AT_ONCE = 4


def _columns(names: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in names]


def _targets(target: str, n_out: int) -> list[Column]:
    return _columns([ahead(target, h) for h in range(n_out)])


def linear_forecast(train: DataFrame, features: Sequence[str], n_out: int, target: str = "diff") -> Linear:
    """Ordinary least squares with a constant for all horizons, from one pass over ``train``."""
    return fit_linear(train, _columns(features), _targets(target, n_out))


def linear_forecast_by(
    train: DataFrame, df: DataFrame, features: Sequence[str], n_out: int, by: str, target: str = "diff", s: Series = DAILY
) -> DataFrame:
    """Predictions of ``df`` by least squares of its own for each value of ``by`` (a cluster, a series), long.

    Values of ``by`` without train rows have no prediction.
    """
    models = fit_groups(gram(train, _columns(features), _targets(target, n_out), [by]), [by])
    rows = predict_groups(df, models, _columns(features), [by], lambda a, b: spread_join(a, b, by, "inner", by=s.time))
    return to_long(rows, F.array(*_targets(target, n_out)), F.col("y_hat"), s, [by] if by not in (s.id, s.time) else [])


def quantile_forecast(
    train: DataFrame, features: Sequence[str], n_out: int, quantiles: Sequence[float] = (0.1, 0.5, 0.9), target: str = "diff"
) -> Quantiles:
    """Linear quantile regression of all horizons and quantiles."""
    return fit_quantiles(train, _columns(features), _targets(target, n_out), quantiles)


def tree_forecast(train: DataFrame, features: Sequence[str], n_out: int, target: str = "diff", depth: int = 10) -> list:
    """One regression tree per horizon; the train rows are stored once, and ``AT_ONCE`` trees grow at the same time."""
    labels = [y.cast("double").alias(f"_y{h}") for h, y in enumerate(_targets(target, n_out))]
    rows = materialize(_vectors(train, features).select("features", *labels))

    def fit(h: int):
        tree = DecisionTreeRegressor(maxDepth=depth, seed=42, labelCol=f"_y{h}", predictionCol=f"_p{h}")
        return tree.fit(rows.select("features", f"_y{h}"))

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(fit, range(n_out)))


def predict_long(df: DataFrame, models: Linear | list, features: Sequence[str], target: str = "diff", s: Series = DAILY) -> DataFrame:
    """Predictions of all horizons next to their targets, long."""
    if isinstance(models, Linear):
        y_hat = models.predict(_columns(features))
        return to_long(df, F.array(*_targets(target, len(y_hat))), F.array(*y_hat), s)
    rows = PipelineModel(models).transform(_vectors(df, features))
    return to_long(rows, F.array(*_targets(target, len(models))), F.array(*[F.col(f"_p{h}") for h in range(len(models))]), s)


def batch_predict(
    windows: DataFrame, models: dict[str, Linear | list] | Quantiles, features: Column, encoder: int, id_col: str = "id"
) -> DataFrame:
    """Tidy predictions of role-declared windows: one row per window and quantile, plus the aligned targets.

    ``forecast_time`` is the last encoder time; ``t+0`` … are the horizons; ``kind`` is ``p10``, ``p50`` … or
    ``targets``. ``features`` makes the model input array from a window. Predictions of a ``Quantiles`` model do not cross.
    """
    rows = windows.withColumns({"_inputs": features, "forecast_time": F.col("time")[encoder - 1], "identifier": F.col(id_col)})

    def linear(width: int) -> list[Column]:
        return [F.col("_inputs")[i] for i in range(width - 1)]

    if isinstance(models, Quantiles):
        values = models.predict(linear(models.models[0].coefficients.shape[1]))
        kinds = list(zip(models.names, values, strict=True))
    else:
        kinds = []
        for name, model in models.items():
            if isinstance(model, Linear):
                kinds.append((name, model.predict(linear(model.coefficients.shape[1]))))
                continue
            rows = rows.withColumn("features", array_to_vector("_inputs"))
            for h, one in enumerate(model):
                rows = one.copy().setPredictionCol(f"_{name}_{h}").transform(rows)
            kinds.append((name, [F.col(f"_{name}_{h}") for h in range(len(model))]))
            rows = rows.drop("features")
    n = max(len(v) for _, v in kinds)
    parts = [F.struct(F.lit(name).alias("kind"), F.array(*v).alias("v")) for name, v in kinds]
    parts.append(F.struct(F.lit("targets").alias("kind"), F.col("outputs").alias("v")))
    out = rows.select("forecast_time", "identifier", F.explode(F.array(*parts)).alias("_k"))
    return out.select("forecast_time", "identifier", F.col("_k.kind").alias("kind"), *[F.get("_k.v", F.lit(h)).alias(f"t+{h}") for h in range(n)])


STATS = ["avg", "std", "median", "min", "max"]


def cluster_buildings(df: DataFrame, k: int = N_CLUSTERS, min_len: int = 15, s: Series = DAILY, col: str = "diff") -> DataFrame:
    """Cluster label of each series by Ward's method over its consumption statistics; short series are left out.

    Labels are numbered by the mean consumption of their cluster.
    """
    stats = building_stats(df, s, col, head=1).filter(F.col("len") >= min_len).select(s.id, *STATS)
    return ward_clusters(stats, STATS, k).select(s.id, "label", *STATS)


def cluster_members(df: DataFrame, labels: DataFrame, s: Series = DAILY) -> DataFrame:
    """Test rows with the cluster of their series; rows of series without one are left out."""
    return spread_join(df, labels.select(s.id, "label"), s.id, "inner", by=s.time)


def cluster_sizes(members: DataFrame) -> DataFrame:
    """Number of rows per cluster."""
    return members.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
