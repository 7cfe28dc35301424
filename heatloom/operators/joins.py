"""Joins of readings with their dimensions and with each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatloom.functions.series import Series
from heatloom.functions.skew import spread_join


def join_meta(df: DataFrame, meta: DataFrame, key: str = "base_id", by: str = "datetime") -> DataFrame:
    """Building metadata of each reading, null where there is none."""
    return spread_join(df, meta, key, by=by)


def join_weather(df: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather of each reading's place and time, null where there is none.

    The time in the key spreads a busy place over as many keys as there are times.
    """
    return df.join(weather, ["datetime", "plz"], "left")


def join_meta_lod(meta: DataFrame, lod: DataFrame, drops: tuple[str, ...] = ()) -> DataFrame:
    """Metadata joined by address with the building model; its area is marked as generated.

    Columns both sides have are taken from the metadata.
    """
    lod = lod.withColumnRenamed("heated_area", "heated_area_lod")
    twice = [c for c in lod.columns if c in meta.columns and c != "address"]
    return spread_join(meta, lod.drop(*twice), "address", "inner", by="id").drop(*drops)


def join_state(df: DataFrame, cities: DataFrame, by: str = "datetime") -> DataFrame:
    """State of each reading's place; readings whose place has none are dropped."""
    known = cities.select("plz", "state").filter(F.col("state").isNotNull())
    return spread_join(df, known, "plz", "inner", by=by)


def holiday_flag(df: DataFrame, holidays: DataFrame, mode: str = "calendar", by: str = "id") -> DataFrame:
    """1 if a reading falls on a holiday of its state.

    ``calendar`` compares dates. ``midnight`` flags interval days only at 00:00 and single days never, which is
    what comparing time stamps with midnights of the interval days gives.
    """
    if mode not in ("calendar", "midnight"):
        raise ValueError("mode must be calendar or midnight")
    ranges = holidays.filter(F.col("start").isNotNull())
    if mode == "midnight":
        ranges = ranges.filter(F.col("end").isNotNull())
    ranges = ranges.withColumn("_end", F.coalesce("end", "start")).filter(F.col("_end") >= F.col("start"))
    days = ranges.select(
        "state", F.explode(F.sequence("start", "_end", F.expr("interval 1 day"))).alias("_day"), F.lit(1).alias("_hit")
    ).distinct()
    out = spread_join(df.withColumn("_day", F.to_date("datetime")), days, ["state", "_day"], by=by)
    hit = F.col("_hit").isNotNull()
    if mode == "midnight":
        hit = hit & (F.col("datetime") == F.col("_day").cast(df.schema["datetime"].dataType))
    return out.withColumn("holiday", hit.cast("bigint")).drop("_day", "_hit")


def join_group_mean(
    df: DataFrame,
    key: str = "base_id",
    col: str = "diff",
    out: str = "daily_avg",
    fit_on: Column | None = None,
    by: str = "datetime",
) -> DataFrame:
    """Mean of ``col`` per group on every row; ``fit_on`` limits the rows it is taken from (all by default)."""
    rows = df if fit_on is None else df.filter(fit_on)
    return spread_join(df, rows.groupBy(key).agg(F.avg(col).alias(out)), key, by=by)


def semi_ids(df: DataFrame, ids: DataFrame, col: str = "id", by: str = "datetime") -> DataFrame:
    """Rows whose id is listed."""
    return spread_join(df, ids.select(col).distinct(), col, "left_semi", by=by)


def anti_ids(df: DataFrame, ids: DataFrame, col: str = "id", by: str = "datetime") -> DataFrame:
    """Rows whose id is not listed."""
    return spread_join(df, ids.select(col).distinct(), col, "left_anti", by=by)


def ids_in_both(a: DataFrame, b: DataFrame, col: str = "id") -> DataFrame:
    """Ids both frames have; each side is reduced to its ids before the shuffle."""
    return a.select(col).distinct().intersect(b.select(col).distinct())


def asof_ffill_join(
    df: DataFrame,
    series: DataFrame,
    on: str = "date",
    value: str = "oil",
    default: float = -1.0,
    by: str = "id",
    calendar: DataFrame | None = None,
) -> DataFrame:
    """Value of a price series on each date, or the last one on an earlier date of ``calendar``, else ``default``.

    ``calendar`` lists the dates over which values are carried, by default those of ``df``; other dates have ``default``.
    """
    days = (df if calendar is None else calendar).select(on).distinct()
    calendar = days.join(series.select(on, value), on, "left").withColumn("_one", F.lit(0))
    dates = Series("day", id="_one", time=on).known(calendar, F.col(value), before="_past")
    filled = dates.select(on, F.coalesce(value, F.col("_past.value")).alias(value))
    return spread_join(df, filled, on, by=by).withColumn(value, F.coalesce(value, F.lit(default)))


def star_enrich(
    fact: DataFrame, stores: DataFrame, items: DataFrame, transactions: DataFrame, default: float = -1
) -> DataFrame:
    """Sales with their store, item and number of transactions of the store on that day."""
    out = spread_join(fact, stores, "store_nbr", by=["item_nbr", "date"])
    out = spread_join(out, items, "item_nbr", by=["store_nbr", "date"])
    out = out.join(transactions, ["date", "store_nbr"], "left")
    return out.withColumn("transactions", F.coalesce("transactions", F.lit(default)))


def scoped_holidays(df: DataFrame, events: DataFrame, by: str = "item_nbr") -> DataFrame:
    """National, regional and local holiday of each row, empty text where there is none.

    Transferred holidays do not count. Where one place has several on a day, the first by name is taken, so that
    rows keep their number and order.
    """
    events = events.filter(~F.col("transferred"))

    def named(scope: str, place: str | None, out: str) -> DataFrame:
        keys = ["date"] + ([F.col("locale_name").alias(place)] if place else [])
        rows = events.filter(F.col("locale") == scope).select(*keys, "description")
        return rows.groupBy(*[c for c in rows.columns if c != "description"]).agg(F.min("description").alias(out))

    for scope, place, out in (("National", None, "national_hol"), ("Regional", "state", "regional_hol"), ("Local", "city", "local_hol")):
        keys = ["date"] + ([place] if place else [])
        df = spread_join(df, named(scope, place, out), keys, by=by).withColumn(out, F.coalesce(out, F.lit("")))
    return df


def sum_meters(
    df: DataFrame, address: str, a: str, b: str, title: str, raw: DataFrame | None = None, time: str = "date"
) -> DataFrame:
    """Replace the rows of ``address`` by meter ``a`` plus meter ``b``, paired by time, under a new title.

    Both meters are read from ``raw`` (the frame itself by default). Where ``b`` has no reading the sum is null.
    """
    source = df if raw is None else raw
    here = source.filter(F.col("adresse") == address)
    other = here.filter(F.col("Title") == b).select(time, F.col("Val").alias("_val"))
    total = here.filter(F.col("Title") == a).join(other, time, "left")
    total = total.withColumns({"Val": F.col("Val") + F.col("_val"), "Title": F.lit(title)}).drop("_val")
    return df.filter(~(F.col("adresse") == address)).unionByName(total)


def subtract_meter(
    df: DataFrame, keep_id: str, remove_id: str, title: str = "Gaszähler", id_col: str = "new_id", time: str = "date"
) -> DataFrame:
    """Replace the rows of one meter by its consumption minus that of another, paired by time.

    Both meters must have the same number of rows, otherwise the query fails.
    """
    keep, remove = F.col(id_col) == keep_id, F.col(id_col) == remove_id
    pair = df.filter(keep | remove)
    same = pair.agg(F.count(F.when(keep, 1)) == F.count(F.when(remove, 1))).scalar()
    other = F.max(F.when(remove, F.col("diff"))).over(Window.partitionBy(time))  # the two readings of one time
    checked = F.when(same, F.col("diff") - F.col("_other")).otherwise(
        F.raise_error(F.lit(f"{keep_id} and {remove_id} differ in length")).cast("double")
    )
    pair = pair.withColumn("_other", other).withColumns(
        {"diff": F.when(keep, checked).otherwise(F.col("diff")), "Title": F.when(keep, F.lit(title)).otherwise(F.col("Title"))}
    )
    return df.filter(~F.coalesce(keep | remove, F.lit(False))).unionByName(pair.select(*df.columns))


def reorder_by_permutation(df: DataFrame, perm: DataFrame, position: str = "position", out: str = "day") -> DataFrame:
    """Original zero-based place of each shuffled row; ``perm`` lists the one-based places in shuffled order.

    A row whose place is not listed fails the query.
    """
    places = perm.select(F.col("position").alias(position), (F.col("value") - 1).alias(out))
    by = [c for c in df.columns if c != position] or [position]
    return require_listed(spread_join(df, places, position, by=by[:1]), {out: position})


def require_listed(df: DataFrame, found: dict[str, str]) -> DataFrame:
    """Fail the query on a row where a joined column is null, naming the key that was not listed."""
    for col, key in found.items():
        missing = F.raise_error(F.concat(F.lit(f"no {col} is listed for {key} "), F.col(key).cast("string")))
        df = df.withColumn(col, F.when(F.col(col).isNull(), missing.cast(df.schema[col].dataType)).otherwise(F.col(col)))
    return df
