"""Whole datasets: enrichment, training frames, and four public series datasets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.functions.columns import base_of
from heatloom.functions.series import Series
from heatloom.functions.skew import spread_join
from heatloom.functions.tables import materialize
from heatloom.operators import cleaning, frames, joins, profile, rows, scaling, splits
from heatloom.schema import (
    CATEGORICAL,
    COLUMN_ROLES,
    CONTINUOUS,
    CONTINUOUS_RES,
    CYCLIC,
    FEATURES,
    Role,
    RunConfig,
    column_with_role,
    columns_of,
    required_features,
)
from heatloom.sources.readers import parse_matrix_lines


@dataclass(frozen=True)
class Dimensions:
    """Tables the readings are enriched from."""

    meta: DataFrame
    weather: DataFrame
    holidays: DataFrame
    cities: DataFrame


def recipe_features(
    readings: DataFrame, dims: Dimensions, s: Series, features: Sequence[str] | None = None
) -> DataFrame:
    """Readings with building, weather, holiday and calendar columns, as id, time and the feature list."""
    df = rows.base_id(readings, "two")
    df = joins.join_meta(df, dims.meta.withColumnRenamed("id", "base_id"))
    df = joins.join_weather(df, dims.weather)
    df = materialize(rows.weekend_flag(rows.null_out_zero(df)))
    df = scaling.label_encode(df, ["typ"])
    df = joins.join_group_mean(df, "base_id")
    df = joins.holiday_flag(joins.join_state(df, dims.cities), dims.holidays)
    df = rows.calendar_parts(df, CYCLIC)
    return df.select(s.id, s.time, *(features or FEATURES[s.step]))


def recipe_training(features: DataFrame, config: RunConfig, s: Series) -> tuple[DataFrame, list[str]]:
    """Lags, complete rows, one energy type, encoded categories and cycles; also the final feature names."""
    wanted = config.features
    df = frames.lag_lead_columns(features, config.lag_in, config.lag_out, s)
    df = frames.drop_incomplete_lags(df, config.lag_in, config.lag_out)
    df = rows.filter_energy(df, config.energy)
    df = materialize(rows.require_features(df, required_features(config.dataset, config.res, wanted)))
    cats = [c for c in CATEGORICAL if c in wanted]
    df, names = scaling.one_hot(df, cats)
    if config.dataset == "missing_data_90":
        df = profile.coverage_filter(df, s)
    else:
        df = rows.exclude_ids(df, config.excluded_ids)
    cycles = [c for c in CYCLIC if c in wanted]
    if cycles:
        df = rows.cyclic_encode(df, cycles)
    plain = [c for c in wanted if c not in cats and c not in cycles]
    return df, plain + names + [f"{c}_{w}" for c in cycles for w in ("sin", "cos")]


def split_frame(df: DataFrame, config: RunConfig, s: Series) -> DataFrame:
    """The split a configuration asks for."""
    if config.split == "group":
        return splits.split_group(df, config.train_per, config.seed, s)
    if config.split == "date":
        return splits.split_date(df, config.split_date, config.n_in + config.n_out, s, config.remove_per)
    if config.split == "time":
        return splits.split_time(df, config.train_per, s, config.remove_per, config.lag_in + config.lag_out)
    raise ValueError(f"unknown split {config.split!r}")


def recipe_prepare(features: DataFrame, config: RunConfig, s: Series) -> tuple[DataFrame, list[str]]:
    """Training frame, split, and scaled by what the train rows show."""
    df, names = recipe_training(features, config, s)
    df = split_frame(df, config, s)
    if config.scaler == "none":
        return df, names
    df = materialize(df)
    cont = [c for c in names if c in CONTINUOUS + CONTINUOUS_RES[config.res]]
    if config.scale_mode == "individual":
        return scaling.standardize_per_series(df, "diff", cont, config.scaler, s).drop("base_id"), names
    if config.scale_mode != "all":
        raise ValueError(f"unknown scale mode {config.scale_mode!r}")
    params = scaling.fit_scaler(df.filter("split = 'train'"), [*cont, "diff"], config.scaler)
    return scaling.apply_scaler(df, params, [*cont, "diff"]), names


# Region of each volatility index (fixed values).
REGIONS = {
    ".AEX": "EMEA",
    ".AORD": "APAC",
    ".BFX": "EMEA",
    ".BSESN": "APAC",
    ".BVLG": "EMEA",
    ".BVSP": "AMER",
    ".DJI": "AMER",
    ".FCHI": "EMEA",
    ".FTMIB": "EMEA",
    ".FTSE": "EMEA",
    ".GDAXI": "EMEA",
    ".GSPTSE": "AMER",
    ".HSI": "APAC",
    ".IBEX": "EMEA",
    ".IXIC": "AMER",
    ".KS11": "APAC",
    ".KSE": "APAC",
    ".MXX": "AMER",
    ".N225": "APAC ",
    ".NSEI": "APAC",
    ".OMXC20": "EMEA",
    ".OMXHPI": "EMEA",
    ".OMXSPI": "EMEA",
    ".OSEAX": "EMEA",
    ".RUT": "EMEA",
    ".SMSI": "EMEA",
    ".SPX": "AMER",
    ".SSEC": "APAC",
    ".SSMI": "EMEA",
    ".STI": "APAC",
    ".STOXX50E": "EMEA",
}
VOLATILITY_ORIGIN = "2000-01-03"


def recipe_volatility(raw: DataFrame, regions: dict[str, str] = REGIONS) -> DataFrame:
    """Calendar columns, region and forward-filled logarithm of the realised volatility of each index."""
    df = rows.calendar_parts(raw, ["day_of_week", "day_of_month", "week_of_year", "month", "year"], "date")
    df = rows.elapsed_time(df, "day", VOLATILITY_ORIGIN, "date")
    df = rows.log_nonzero(df, "rv5_ss", "log_vol")
    df = rows.static_map(df, "Symbol", regions, "Region").withColumn("categorical_id", F.col("Symbol"))
    return cleaning.ffill(df, ["log_vol"], Series("day", id="Symbol", time="date"))


def recipe_electricity(
    wide: DataFrame, time: str = "ts", first_day: int = 1096, last_day: int = 1345
) -> DataFrame:
    """Hourly usage per customer from a table with one column per customer.

    Each series runs from its first to its last non-zero hour; hours without a reading in between are zero.
    """
    customers = [c for c in wide.columns if c != time]
    long = wide.unpivot([time], customers, "id", "power_usage").withColumnRenamed(time, "date")
    s = Series("hour", time="date")
    hourly = profile.rollup_hourly_mean(long, ["power_usage"], ["id"], "date")
    start = hourly.agg(F.min("date").alias("t")).scalar()
    df = cleaning.active_range(cleaning.fill_grid(materialize(hourly), s), "power_usage", s)
    df = rows.calendar_parts(df, ["hour", "day_of_month", "day_of_week", "month"], "date")
    df = df.withColumnRenamed("day_of_month", "day")
    hours = s.steps(start, F.col("date"))
    df = df.withColumns({"hours_from_start": hours, "days_from_start": F.floor(hours / 24).cast("bigint")})
    df = df.withColumns(
        {
            "t": F.col("hours_from_start"),
            "categorical_id": F.col("id"),
            "categorical_day_of_week": F.col("day_of_week"),
            "categorical_hour": F.col("hour"),
        }
    )
    return df.filter(F.col("days_from_start").between(first_day, last_day))


def recipe_traffic(
    lines: DataFrame,
    perm: DataFrame,
    weekdays: DataFrame,
    stations: DataFrame,
    slots_per_hour: int = 6,
    last_day: int = 172,
) -> DataFrame:
    """Hourly occupancy per sensor from shuffled day matrices, with the value before and after.

    ``lines`` has one matrix per day (``line_no, line``); ``perm``, ``weekdays`` and ``stations`` are
    ``position, value`` lists.
    """
    cells = parse_matrix_lines(lines.withColumnRenamed("line_no", "position"))
    hour = F.floor(F.col("slot") / slots_per_hour).cast("bigint")
    wrong = F.raise_error(F.lit("a day has more than 24 hours")).cast("bigint")
    cells = cells.withColumn("time_on_day", F.when(hour < 24, hour).otherwise(wrong))
    hourly = cells.groupBy("position", "row", "time_on_day").agg(F.avg("value").alias("values"))
    hourly = joins.reorder_by_permutation(hourly, perm, out="sensor_day")
    kinds = weekdays.select("position", F.col("value").alias("day_of_week"))
    hourly = spread_join(hourly, kinds, "position", by=["row", "time_on_day"])
    names = stations.select(F.col("position").alias("row"), F.col("value").alias("id"))
    hourly = spread_join(hourly, names, "row", by=["sensor_day", "time_on_day"])
    hourly = joins.require_listed(hourly, {"day_of_week": "position", "id": "row"}).drop("row", "position")
    start = F.col("time_on_day") + F.col("sensor_day") * 24
    df = hourly.withColumns({"hours_from_start": start, "_at": F.timestamp_seconds(start * 3600)})
    s = Series("hour", time="_at")
    df = cleaning.prev_next(cleaning.ffill(materialize(df), ["values"], s), "values", s).drop("_at")
    key = rows.composite_key(df, ["id", "sensor_day", "time_on_day"], [None, 3, 3])
    return key.filter(F.col("sensor_day") <= last_day).withColumns(
        {
            "categorical_id": F.col("id"),
            "categorical_day_of_week": F.col("day_of_week"),
            "categorical_time_on_day": F.col("time_on_day"),
        }
    )


@dataclass(frozen=True)
class RetailTables:
    """Dimension tables of the sales data."""

    stores: DataFrame
    items: DataFrame
    oil: DataFrame
    transactions: DataFrame
    holidays: DataFrame


def recipe_retail(
    sales: DataFrame, tables: RetailTables, start: str = "2015-01-01", end: str = "2016-06-01"
) -> DataFrame:
    """Daily sales per store and item on a full grid, with oil price, store, item, calendar and holidays.

    The oil price is carried over the days on which anything was sold; other days have none (-1).
    Items of a store that ever had a negative sale are left out.
    """
    kind = sales.schema["date"].dataType
    day = F.col("date")
    df = sales.filter((day >= F.lit(start).cast(kind)) & (day < F.lit(end).cast(kind)))
    calendar = df.select("date").distinct()  # days with any sale, of returned items too
    df = rows.composite_key(df, ["store_nbr", "item_nbr"], out="traj_id")
    df = profile.filter_groups_min(df, "traj_id", "unit_sales", 0)
    df = materialize(df)
    df = materialize(cleaning.resample_last(df, ["store_nbr", "item_nbr", "onpromotion"]))
    df = joins.asof_ffill_join(df, tables.oil, by="traj_id", calendar=calendar)
    df = joins.star_enrich(df, tables.stores, tables.items, tables.transactions)
    df = rows.calendar_parts(df, ["day_of_week", "day_of_month", "month"], "date")
    df = joins.scoped_holidays(df, tables.holidays)
    unique = F.concat_ws("_", "traj_id", F.date_format("date", "yyyy-MM-dd"))
    return df.withColumn("unique_id", unique)


def scale_roles(df: DataFrame, roles: Sequence[Role], unscaled: Sequence[str] = ()) -> DataFrame:
    """Fill and scale the inputs of a role-declared dataset by what its train rows show.

    The target is scaled per base series, other numbers over all, categories become the codes that train gives them; a
    category that train does not have fails the query.
    """
    id_col, target = (column_with_role(list(roles), r) for r in ("id", "target"))
    real = [c for c in columns_of(list(roles), "real", ("id", "time", "target")) if c not in unscaled]
    cat = columns_of(list(roles), "categorical", ("id", "time"))
    df = materialize(scaling.fill_before_scale(df, [*real, target], cat))
    train = df.filter("split = 'train'")
    df = df.withColumn("base_id", base_of(id_col, "all"))
    params = scaling.fit_scaler(train.withColumn("base_id", base_of(id_col, "all")), [target], by="base_id")
    spread = column_with_role(list(roles), "time")
    df = scaling.apply_scaler(df, params, [target], "base_id", spread=spread).drop("base_id")
    if real:
        df = scaling.apply_scaler(df, scaling.fit_scaler(train, real), real)
    return scaling.label_encode(df, cat, by=spread, fitted=scaling.fit_codes(train, cat)) if cat else df


def recipe_windowing(
    df: DataFrame,
    roles: Sequence[Role],
    total: int,
    encoder: int,
    s: Series,
    train_per: float = 0.8,
    remove_per: float = 0.0,
    min_len: int | None = None,
) -> DataFrame:
    """Split, scale and window a role-declared dataset; windows stay inside their split."""
    df = splits.split_time(df, train_per, s, remove_per, total if min_len is None else min_len)
    df = scale_roles(df, roles, [f"{c}_{w}" for c in CYCLIC for w in ("sin", "cos")])
    return windows_of_parts(df, roles, total, encoder, s)


def windows_of_parts(df: DataFrame, roles: Sequence[Role], total: int, encoder: int, s: Series) -> DataFrame:
    """Windows of each split by itself; a row may be in several."""
    id_col = column_with_role(list(roles), "id")
    df = materialize(df.withColumn("_part", F.concat_ws("|", "split", id_col)))
    windows = frames.sliding_windows(df, roles, total, encoder, s=replace(s, id="_part"))
    split: Column = F.substring_index("_part", "|", 1)
    return windows.withColumn("split", split).drop("_part")


def recipe_volatility_windows(
    df: DataFrame, total: int, encoder: int, valid: int = 2016, test: int = 2018, end: str = "2019-06-28", s: Series | None = None
) -> DataFrame:
    """Windows of the volatility data: cut by year, numbers scaled over all series, categories coded, both as train shows them."""
    roles = COLUMN_ROLES["volatility"]
    real, cat = columns_of(roles, "real", ("id", "time")), columns_of(roles, "categorical", ("id", "time"))
    df = splits.split_year(df, valid, test, end).select("Symbol", "date", "split", *real, *cat)
    df = materialize(df)
    train = df.filter("split = 'train'")
    df = scaling.apply_scaler(df, scaling.fit_scaler(train, real), real)
    df = scaling.label_encode(df, cat, by="date", fitted=scaling.fit_codes(train, cat))
    return windows_of_parts(df, roles, total, encoder, s or Series("day", id="Symbol", time="date"))


def recipe_electricity_windows(
    df: DataFrame, total: int, encoder: int, valid: int = 1315, test: int = 1339, overlap: int = 7, s: Series | None = None
) -> DataFrame:
    """Windows of the electricity data, timed by ``date``: cut by day with overlaps, numbers scaled per customer as in train.

    Customers with fewer than ``total`` hours in train are left out, and parts shorter than that give no window.
    """
    roles = [Role("date", "date", "time") if r.role == "time" else r for r in COLUMN_ROLES["electricity"]]
    real, cat = columns_of(roles, "real", ("id", "time")), columns_of(roles, "categorical", ("id", "time"))
    df = splits.split_boundary_overlap(df, valid, test, overlap).select("id", "date", "split", *real, *cat)
    df = materialize(df)
    fitted = scaling.fit_codes(df.filter("split = 'train'"), cat)
    df = scaling.standardize_per_entity(df, real, total, by="date")
    df = scaling.label_encode(df, cat, by="date", fitted=fitted)
    return windows_of_parts(df, roles, total, encoder, s or Series("hour", time="date"))
