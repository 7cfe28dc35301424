"""Encoding and scaling.

A fitted scaler is a table: one row in all, or one per series, with ``<col>_shift`` and ``<col>_scale`` columns, so
that scaled = (x - shift) / scale.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.functions.columns import base_of
from heatloom.functions.order import sorted_offset
from heatloom.functions.series import DAILY, Series
from heatloom.functions.skew import spread_join

def _category(col: str, unknown: str | None) -> Column:
    value = F.col(col).cast("string")
    return value if unknown is None else F.coalesce(value, F.lit(unknown))


def fit_codes(train: DataFrame, cols: Sequence[str], unknown: str | None = None) -> dict[str, DataFrame]:
    """For each column a table of its categories (``_cat``) and their positions in alphabetical order (``_code``)."""
    out = {}
    for c in cols:
        known = train.select(_category(c, unknown).alias("_cat")).filter(F.col("_cat").isNotNull()).distinct()
        out[c] = sorted_offset(known, ["_cat"], F.lit(1).cast("long"), "_code").select("_cat", "_code")
    return out


def label_encode(
    df: DataFrame,
    cols: Sequence[str],
    by: str = "datetime",
    unknown: str | None = None,
    fitted: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """Replace categories by their position in alphabetical order; null stays null unless ``unknown`` names it.

    With ``fitted`` (see ``fit_codes``) the positions are those of the frame it was fitted on, and a category that
    frame did not have fails the query.
    """
    codes = fitted if fitted is not None else fit_codes(df, cols, unknown)
    for c in cols:
        df = spread_join(df.withColumn("_cat", _category(c, unknown)), codes[c], "_cat", by=by)
        unseen = F.raise_error(F.concat(F.lit(f"{c} was not fitted on "), F.col("_cat"))).cast("bigint")
        code = F.when(F.col("_cat").isNotNull() & F.col("_code").isNull(), unseen).otherwise(F.col("_code"))
        df = df.withColumn(c, code).drop("_cat", "_code")
    return df


def categories(df: DataFrame, col: str) -> list[str]:
    """Sorted categories of a column that becomes one column per category."""
    found = df.select(F.col(col).cast("string").alias("c")).distinct().collect()
    return sorted((r["c"] for r in found if r["c"] is not None))


def one_hot(
    df: DataFrame, cols: Sequence[str], values: dict[str, Sequence[str]] | None = None
) -> tuple[DataFrame, list[str]]:
    """Replace each column by 0/1 columns ``<col>_<value>``, one per category, and list their names.

    Categories are those of ``df`` unless ``values`` fixes them, if only as an empty list; a category that is not
    listed gives zeros.
    """
    flags = {}
    for c in cols:
        for v in values[c] if values is not None and c in values else categories(df, c):
            flags[f"{c}_{v}"] = F.coalesce(F.col(c).cast("string") == v, F.lit(False)).cast("double")
    return df.withColumns(flags).drop(*cols), list(flags)


def fit_scaler(
    train: DataFrame, cols: Sequence[str], kind: str = "standard", by: str | None = None, min_len: int | None = None
) -> DataFrame:
    """Parameters of ``standard`` or ``minmax`` scaling, over all rows or per ``by``.

    Deviations are those of the population; a column that does not vary is only shifted.
    """
    parts = []
    for c in cols:
        if kind == "standard":
            shift, scale = F.avg(F.col(f"`{c}`")), F.stddev_pop(F.col(f"`{c}`"))
        elif kind == "minmax":
            shift, scale = F.min(F.col(f"`{c}`")), F.max(F.col(f"`{c}`")) - F.min(F.col(f"`{c}`"))
        else:
            raise ValueError(f"unknown scaler {kind!r}")
        one = F.when(scale == 0, F.lit(1.0)).otherwise(scale)
        parts += [shift.alias(f"{c}_shift"), one.alias(f"{c}_scale")]
    if by is None:
        return train.agg(*parts)
    params = train.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), *parts)
    if min_len is not None:
        params = params.filter(F.col("_n") >= min_len)
    return params.drop("_n")


def apply_scaler(
    df: DataFrame,
    params: DataFrame,
    cols: Sequence[str],
    by: str | None = None,
    how: str = "inner",
    inverse: bool = False,
    spread: str | Sequence[str] = "datetime",
    params_of: str | None = None,
) -> DataFrame:
    """Scale ``cols`` with fitted parameters, or undo it; ``params_of`` names the fitted column if it differs."""
    if by is None:
        row = params.select(F.struct("*")).scalar()
        part = lambda name: row[name]
    else:
        df = spread_join(df, params, by, how, by=spread)
        part = lambda name: F.col(f"`{name}`")

    def value(c: str) -> Column:
        shift, scale = part(f"{params_of or c}_shift"), part(f"{params_of or c}_scale")
        x = F.col(f"`{c}`")
        if inverse:
            return x * F.coalesce(scale, F.lit(1.0)) + F.coalesce(shift, F.lit(0.0))
        return (x - shift) / scale

    out = df.withColumns({c: value(c) for c in cols})
    return out if by is None else out.drop(*[c for c in params.columns if c != by])


def standardize_global(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """z-scores of ``cols``; the parameters come from the train rows."""
    return apply_scaler(df, fit_scaler(df.filter("split = 'train'"), cols), cols)


def minmax_global(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scale ``cols`` to the range of the train rows."""
    return apply_scaler(df, fit_scaler(df.filter("split = 'train'"), cols, "minmax"), cols)


def standardize_per_series(
    df: DataFrame, target: str, cols: Sequence[str], kind: str = "standard", s: Series = DAILY
) -> DataFrame:
    """Scale the target per base series and the other columns over all, both fitted on the train rows.

    Series without train rows are dropped. The base id is matched exactly.
    """
    rows = df.withColumn("base_id", base_of(s.id, "two"))
    train = rows.filter("split = 'train'")
    if cols:
        rows = apply_scaler(rows, fit_scaler(train, cols, kind), cols)
    return apply_scaler(rows, fit_scaler(train, [target], kind, "base_id"), [target], "base_id", spread=s.time)


def standardize_per_entity(
    df: DataFrame, cols: Sequence[str], min_len: int, id_col: str = "id", by: str = "datetime"
) -> DataFrame:
    """z-scores per series of every column; series with fewer than ``min_len`` train rows are dropped."""
    params = fit_scaler(df.filter("split = 'train'"), cols, by=id_col, min_len=min_len)
    return apply_scaler(df, params, cols, id_col, spread=by)


def inverse_scale(
    pred: DataFrame,
    params: DataFrame,
    cols: Sequence[str] = ("y_hat",),
    target: str = "diff",
    id_col: str = "id",
    by: str | Sequence[str] = ("datetime", "h"),
) -> DataFrame:
    """Predictions in original units by base id; rows without a scaler stay as they are."""
    rows = pred.withColumn("base_id", base_of(id_col, "all"))
    return apply_scaler(rows, params, cols, "base_id", "left", True, by, target).drop("base_id")


def fill_before_scale(df: DataFrame, real: Sequence[str], cat: Sequence[str], unknown: str = "unknown") -> DataFrame:
    """Unknown numbers become zero and unknown categories a category of their own."""
    return df.fillna(0, subset=list(real)).withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit(unknown)) for c in cat}
    )


def column_transformer(
    df: DataFrame, num: Sequence[str], cat: Sequence[str], binary: Sequence[str], target: str = "diff"
) -> tuple[DataFrame, list[str]]:
    """z-scores, 0/1 columns and unchanged columns, fitted on train, for all splits; the target is scaled too.

    A category that train does not have gives zeros.
    """
    train = df.filter("split = 'train'")
    kept = [c for c in df.columns if c in ("id", "datetime", "split")]
    values = {c: categories(train, c) for c in cat}
    rows = apply_scaler(df, fit_scaler(train, [*num, target]), [*num, target])
    rows, names = one_hot(rows, cat, values)
    features = [*num, *names, *binary]
    return rows.select(*kept, *[F.col(f"`{c}`") for c in features], target), features


def persistence_forecast(df: DataFrame, cols: Sequence[str], n_future: int, s: Series = DAILY) -> DataFrame:
    """Forecasts ``<f>_n``, ``<f>(t+i)_n`` of covariates that repeat the previous row's value at every step.

    The first row of a series has none.
    """
    rows = s.adjacent(df, list(cols))
    paths = {noisy(c, i): F.col("_prev")[c].cast("double") for c in cols for i in range(n_future)}
    return rows.withColumns(paths).drop("_prev")


def noisy(col: str, i: int) -> str:
    return f"{col}(t+{i})_n" if i else f"{col}_n"


def noise_rmse(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Root mean squared error of each forecast column against the recorded one, and their mean."""
    errors = [F.sqrt(F.avg(F.pow(F.col(c) - F.col(noisy(c, 0)), 2))).alias(c) for c in cols]
    rows = df.agg(*errors).unpivot([], list(cols), "feature", "rmse")
    return rows.unionByName(rows.agg(F.lit("mean").alias("feature"), F.avg("rmse").alias("rmse")))


def swap_in_noise(
    df: DataFrame, cols: Sequence[str], n_future: int, suffix: str = "(t+{i})"
) -> DataFrame:
    """In the test split, covariates from the current step on are replaced by their forecasts.

    Rows left with a null are dropped from test; the forecast columns go.
    """
    noise = [(c if i == 0 else c + suffix.format(i=i), noisy(c, i)) for c in cols for i in range(n_future)]
    test = F.col("split") == "test"
    swapped = {real: F.when(test, F.col(f"`{n}`")).otherwise(F.col(f"`{real}`")) for real, n in noise}
    rows = df.withColumns(swapped).drop(*[n for _, n in noise])
    full = F.lit(True)
    for c in rows.columns:
        full = full & F.col(f"`{c}`").isNotNull()
    return rows.filter(~test | full)
