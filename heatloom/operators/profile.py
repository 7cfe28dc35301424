"""Aggregations, gaps and descriptive statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatloom.functions.order import column_quantiles, quantiles
from heatloom.functions.series import DAILY, HOURLY, SLICE, Series
from heatloom.functions.skew import spread_join


def date_ranges(df: DataFrame, key: str = "id", time: str = "datetime") -> DataFrame:
    """First and last time and number of rows per key."""
    return df.groupBy(key).agg(
        F.min(time).alias("min_date"), F.max(time).alias("max_date"), F.count(F.lit(1)).alias("n")
    )


def _points(start: Column, end: Column, s: Series) -> tuple[Column, Column]:
    """Grid points between two times in two steps, so that no single array holds a whole series."""
    hop = F.expr(f"interval {s.count * s.points} {s.step}")
    blocks = F.sequence(start, end, hop)

    def inside(block: Column) -> Column:
        return F.sequence(block, F.least(end, block + hop - s.interval), s.interval)

    return blocks, inside


def _scattered(df: DataFrame, *cols: str) -> DataFrame:
    """Few rows that are about to become many, spread over all tasks (a fixed number, so that it stays that way)."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def date_spine(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Every grid point between the first and last reading of each series."""
    ends = df.groupBy(s.id).agg(F.min(s.time).alias("_lo"), F.max(s.time).alias("_hi"))
    blocks, inside = _points(F.col("_lo"), F.col("_hi"), s)
    rows = _scattered(ends.select(s.id, "_hi", F.explode(blocks).alias("_block")), s.id, "_block")
    return rows.select(s.id, F.explode(inside(F.col("_block"))).alias(s.time))


def missing_points(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Coverage per series: absent grid points, readings, percentage of the grid, first and last time.

    The percentage divides by the grid length plus one, so a complete series stays just below 100.
    """
    per = df.groupBy(s.id).agg(
        F.count(F.lit(1)).alias("n"), F.min(s.time).alias("start_date"), F.max(s.time).alias("end_date")
    )
    grid = s.steps(F.col("start_date"), F.col("end_date")) + 1
    repeated = F.raise_error(F.concat(F.lit("more readings than grid points in "), F.col(s.id).cast("string"))).cast("bigint")
    return per.select(
        s.id,
        F.when(F.col("n") > grid, repeated).otherwise(grid - F.col("n")).alias("len"),
        "n",
        (F.col("n") / (grid + 1) * 100).alias("per"),
        "start_date",
        "end_date",
    )


def gap_spans(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Runs of consecutive absent grid points: first, last and number of them."""
    rows = s.adjacent(df, [])
    before = F.col("_prev")[s.time]
    return rows.withColumn("n", s.steps(before, F.col(s.time)) - 1).filter(F.col("n") > 0).select(
        s.id, (before + s.interval).alias("start"), (F.col(s.time) - s.interval).alias("end"), "n"
    )


def missing_dates(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """One row per absent grid point of each series."""
    spans = gap_spans(df, s)
    blocks, inside = _points(F.col("start"), F.col("end"), s)
    rows = _scattered(spans.select(s.id, "end", F.explode(blocks).alias("_block")), s.id, "_block")
    return rows.select(s.id, F.explode(inside(F.col("_block"))).alias("missing_date"))


def missing_lists(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Absent grid points as sorted lists, one per series and time slice so that a list stays short."""
    slices = Series(s.step, s.id, "missing_date", s.count, s.points).sliced(missing_dates(df, s))
    return slices.groupBy(s.id, F.col(SLICE).alias("slice")).agg(
        F.array_sort(F.collect_list("missing_date")).alias("missing_dates"), F.count(F.lit(1)).alias("len")
    )


def coverage_filter(df: DataFrame, s: Series = DAILY, min_per: float = 90) -> DataFrame:
    """Rows of series whose coverage is above ``min_per`` percent."""
    good = missing_points(df, s).filter(F.col("per") > min_per).select(s.id)
    return spread_join(df, good, s.id, "left_semi", by=s.time)


def rollup_daily_sum(df: DataFrame, s: Series = HOURLY, col: str = "diff") -> DataFrame:
    """Consumption per series and day."""
    day = F.date_trunc("day", F.col(s.time)).cast(df.schema[s.time].dataType).alias(s.time)
    return df.groupBy(s.id, day).agg(F.sum(col).alias(col))


def rollup_humidity(weather: DataFrame, time: str = "time", col: str = "rhum") -> DataFrame:
    """Daily mean, lowest and highest humidity per place."""
    day = F.date_trunc("day", F.col(time)).cast(weather.schema[time].dataType).alias(time)
    return weather.groupBy("plz", day).agg(
        F.avg(col).alias("hum_avg"), F.min(col).alias("hum_min"), F.max(col).alias("hum_max")
    )


def weather_merge(humidity: DataFrame, daily: DataFrame, time: str = "time") -> DataFrame:
    """Daily humidity with the other daily weather columns, null where there are none."""
    return humidity.join(daily, ["plz", time], "left")


def rollup_hourly_mean(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), time: str = "datetime") -> DataFrame:
    """Hourly means; a mean of zero counts as unknown."""
    hour = F.date_trunc("hour", F.col(time)).cast(df.schema[time].dataType).alias(time)
    return df.groupBy(*by, hour).agg(*[F.nullif(F.avg(c), F.lit(0.0)).alias(c) for c in cols])


def building_stats(df: DataFrame, s: Series = DAILY, col: str = "diff", head: int = 30) -> DataFrame:
    """Mean, deviation, median, extremes, length and the first ``head`` readings of each series."""
    also = {
        "avg": F.avg(col),
        "std": F.stddev_samp(col),
        "min": F.min(col),
        "max": F.max(col),
        "len": F.count(F.lit(1)),
    }
    stats = quantiles(df, s.id, col, {"median": 0.5}, spread=s.time, also=also).drop("n")
    first = s.numbered(df.select(s.id, s.time, col)).filter(F.col("_pos") < head)
    first = first.groupBy(s.id).agg(F.array_sort(F.collect_list(F.struct("_pos", col))).alias("_rows"))
    first = first.select(s.id, F.transform("_rows", lambda r: r[col]).alias("month"))
    return stats.join(first, s.id, "left").select(s.id, "avg", "std", "min", "max", "len", "median", "month")


def length_filter(df: DataFrame, min_len: int = 15, id_col: str = "id") -> DataFrame:
    """Ids with at least ``min_len`` rows and their number of rows."""
    return df.groupBy(id_col).agg(F.count(F.lit(1)).alias("len")).filter(F.col("len") >= min_len)


def drop_all_null_series(df: DataFrame, features: Sequence[str], s: Series = DAILY) -> DataFrame:
    """Drop series in which at least one of ``features`` is null throughout."""
    counts = df.groupBy(s.id).agg(*[F.count(f).alias(f) for f in features])
    empty = F.lit(False)
    for f in features:
        empty = empty | (F.col(f) == 0)
    return spread_join(df, counts.filter(empty).select(s.id), s.id, "left_anti", by=s.time)


def filter_groups_min(
    df: DataFrame, key: str, col: str, min_value: float = 0, by: str | Sequence[str] = "date"
) -> DataFrame:
    """Rows of groups whose smallest value is at least ``min_value``."""
    bad = df.groupBy(key).agg(F.min(col).alias("_min"))
    good = bad.filter(F.col("_min") >= min_value).select(key)
    return spread_join(df, good, key, "left_semi", by=by)


def series_length_report(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Length per series, followed by rows for the mean, median and standard deviation of the lengths."""
    lengths = df.groupBy(id_col).agg(F.count(F.lit(1)).cast("double").alias("len"))
    spread = lengths.agg(F.avg("len").alias("mean"), F.stddev_samp("len").alias("std"))
    spread = spread.unpivot([], ["mean", "std"], id_col, "len")
    median = quantiles(lengths, [], "len", {"len": 0.5}).select(F.lit("median").alias(id_col), "len")
    return lengths.unionByName(spread).unionByName(median)


def mode_value(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Most frequent value per group, the smallest of equally frequent ones."""
    def only(i: int) -> Column:
        """The value of one column, with its number; the others are null."""
        kinds = [df.schema[c].dataType for c in cols]
        return F.struct(F.lit(i).alias("_i"), *[(F.col(c) if j == i else F.lit(None).cast(kinds[j])).alias(f"_c{j}") for j, c in enumerate(cols)])

    names = [f"_c{i}" for i in range(len(cols))]
    counts = df.select(key, F.inline(F.array(*[only(i) for i in range(len(cols))]))).groupBy(key, "_i", *names).agg(F.count(F.lit(1)).alias("_n"))
    known = [F.when((F.col("_i") == i) & F.col(n).isNotNull(), F.struct(-F.col("_n"), F.col(n))) for i, n in enumerate(names)]
    best = counts.groupBy(key).agg(*[F.min_by(n, k).alias(c) for n, k, c in zip(names, known, cols, strict=True)])
    return best.dropna(how="all", subset=list(cols))


def dedup_keys(df: DataFrame, keys: Sequence[str] = ("id", "datetime"), order: Sequence[str] = ("diff",)) -> DataFrame:
    """One row per key, the smallest by ``order`` and then by the other columns."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*order, *[c for c in rest if c not in order])
    best = df.groupBy(*keys).agg(F.min(ranked).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def describe_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles, one row per column."""
    value = lambda c: F.col(f"`{c}`").cast("double")
    also = {
        "count": lambda c: F.count(value(c)),
        "mean": lambda c: F.avg(value(c)),
        "std": lambda c: F.stddev_samp(value(c)),
        "min": lambda c: F.min(value(c)),
        "max": lambda c: F.max(value(c)),
    }
    return column_quantiles(df, list(cols), {"q25": 0.25, "q50": 0.5, "q75": 0.75}, also=also)


def missingness_profile(df: DataFrame) -> DataFrame:
    """Type, number of present and absent values and percentage absent, one row per column."""
    cols = df.columns
    rows = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(c)).alias(c) for c in cols])
    long = rows.unpivot(["_rows"], cols, "column", "non_null")
    kinds = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    absent = F.col("_rows") - F.col("non_null")
    return long.select(
        "column",
        kinds[F.col("column")].alias("type"),
        "non_null",
        absent.alias("missing"),
        (absent / F.col("_rows") * 100).alias("missing_pct"),
    )


def histogram(df: DataFrame, col: str = "diff", bins: int = 50) -> DataFrame:
    """Equal-width bins from the smallest to the largest value, empty bins included."""
    ends = df.agg(F.struct(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))).scalar()
    rows = df.filter(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("_v"), ends.alias("_e"))
    width = (F.col("_e.hi") - F.col("_e.lo")) / F.lit(bins)
    place = F.coalesce(F.floor((F.col("_v") - F.col("_e.lo")) / F.nullif(width, F.lit(0.0))), F.lit(0))
    counts = rows.groupBy(F.least(place, F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(bins).select(F.col("id").alias("bin"), ends.alias("_e"))
    return grid.join(counts, "bin", "left").select(
        "bin",
        (F.col("_e.lo") + width * F.col("bin")).alias("start"),
        (F.col("_e.lo") + width * (F.col("bin") + 1)).alias("end"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def dataset_comparison(a: DataFrame, b: DataFrame, target: str = "diff", id_col: str = "id", time: str = "datetime") -> DataFrame:
    """Size, devices, date range and target statistics of two frames side by side, as text."""

    def summary(df: DataFrame, name: str) -> DataFrame:
        number = lambda c: F.format_string("%.2f", c.cast("double"))
        moment = lambda c: F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
        parts = {
            "rows": F.count(F.lit(1)).cast("string"),
            "columns": F.lit(str(len(df.columns))),
            "devices": F.countDistinct(id_col).cast("string"),
            "start": moment(F.min(time)),
            "end": moment(F.max(time)),
            "mean": number(F.avg(target)),
            "std": number(F.stddev_samp(target)),
            "min": number(F.min(target)),
            "max": number(F.max(target)),
        }
        row = df.agg(*[c.alias(k) for k, c in parts.items()])
        return row.unpivot([], list(parts), "metric", name)

    return summary(a, "first").join(summary(b, "second"), "metric")


def split_date_ranges(df: DataFrame, step: str = "day", time: str = "datetime") -> DataFrame:
    """First and last time, whole steps between them and number of rows per split."""
    s = Series(step, time=time)
    out = df.groupBy("split").agg(
        F.min(time).alias("start"), F.max(time).alias("end"), F.count(F.lit(1)).alias("samples")
    )
    return out.withColumn("steps", s.steps(F.col("start"), F.col("end")))


def split_series_stats(df: DataFrame, id_col: str = "id") -> DataFrame:
    """Number of series per split and the spread of their lengths."""
    lengths = df.groupBy("split", id_col).agg(F.count(F.lit(1)).alias("n"))
    stats = lengths.groupBy("split").agg(
        F.count(F.lit(1)).alias("series"), F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean")
    )
    return stats.join(quantiles(lengths, "split", "n", {"median": 0.5}, few_groups=True).drop("n"), "split", "left")


def reduction_report(stages: Sequence[tuple[str, DataFrame]], id_col: str = "id") -> DataFrame:
    """Rows and series left after each stage, and how many of the first stage that loses in number and percent."""
    out = None
    for i, (name, df) in enumerate(stages):
        row = df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(id_col).alias("series"))
        row = row.select(F.lit(i).alias("_i"), F.lit(name).alias("stage"), "rows", "series")
        out = row if out is None else out.unionByName(row)
    w = Window.partitionBy(F.lit(0)).orderBy("_i")  # one row per stage
    first = {c: F.first(c).over(w) for c in ("rows", "series")}
    return out.select(
        "stage",
        "rows",
        "series",
        (first["rows"] - F.col("rows")).alias("rows_lost"),
        ((first["rows"] - F.col("rows")) / first["rows"] * 100).alias("rows_lost_pct"),
        (first["series"] - F.col("series")).alias("series_lost"),
    )


def split_shares(df: DataFrame) -> DataFrame:
    """Share of the rows in each split."""
    counts = df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    total = F.sum("rows").over(Window.partitionBy(F.lit(0)))  # one row per split
    return counts.withColumn("pct", F.col("rows") / total * 100)


def longest_series_head(df: DataFrame, n: int, s: Series = DAILY) -> DataFrame:
    """First ``n`` rows of the series with most rows (the first by id among equals)."""
    counts = df.groupBy(s.id).agg(F.count(F.lit(1)).alias("_n"))
    longest = counts.orderBy(F.desc("_n"), s.id).limit(1).select(s.id).scalar()
    return df.filter(F.col(s.id) == longest).orderBy(s.time).limit(n)


def time_window_slice(df: DataFrame, days: int = 14, s: Series = DAILY) -> DataFrame:
    """Rows of each series within ``days`` days of its first reading."""
    starts = df.groupBy(s.id).agg(F.min(s.time).alias("_start"))
    rows = spread_join(df, starts, s.id, "inner", by=s.time)
    return rows.filter(F.col(s.time) <= F.col("_start") + F.expr(f"interval {days} days")).drop("_start")


def sample_rows(df: DataFrame, n: int = 10_000, keys: Sequence[str] = ("id", "datetime"), seed: int = 42) -> DataFrame:
    """At most ``n`` rows, chosen by a seeded hash of their key (unique per row); the same rows every time.

    Only keys are sorted, and of those each task keeps the first ``n``.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    chosen = df.select(*keys, F.md5(text.cast("binary")).alias("_hash")).orderBy("_hash", *keys).limit(n).drop("_hash")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return df.alias("a").join(chosen.alias("b"), same, "left_semi")
