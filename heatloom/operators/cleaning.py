"""Cleaning and repair of series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatloom.functions.order import quantiles
from heatloom.functions.series import DAILY, SLICE, Series
from heatloom.functions.skew import spread_join
from heatloom.schema import FLAT_LINE_LIMIT, RECONNECT_GAP


def counter_to_diff(df: DataFrame, s: Series = DAILY, counter: str = "value", out: str = "diff") -> DataFrame:
    """Consumption as the step of the counter since the previous row; null in the first row."""
    rows = s.adjacent(df, [counter])
    return rows.withColumn(out, F.col(counter) - F.col("_prev")[counter]).drop("_prev")


def drop_leading_zeros(df: DataFrame, s: Series = DAILY, diff: str = "diff", counter: str = "value") -> DataFrame:
    """Drop rows before the first positive consumption, then rows whose counter equals it (the bogus first step)."""
    first = F.min(F.when(F.col(diff) > 0, F.col(s.time)))
    rows = s.totals(df, {"_start": (first, F.min)})
    return rows.filter((F.col(s.time) >= F.col("_start")) & (F.col(counter) != F.col(diff))).drop("_start")


def drop_reconnect_spikes(df: DataFrame, s: Series = DAILY, min_gap: int | None = None) -> DataFrame:
    """Drop the first reading after a gap, which holds the consumption of the whole gap.

    By default every daily gap counts, and hourly gaps of more than two missing readings.
    """
    min_gap = RECONNECT_GAP[s.step] if min_gap is None else min_gap
    rows = s.adjacent(df, [])
    gap = s.steps(F.col("_prev")[s.time], F.col(s.time)) - 1
    return rows.filter(F.coalesce(gap < min_gap, F.lit(True))).drop("_prev")


def iqr_bounds(df: DataFrame, s: Series = DAILY, col: str = "diff", k: float = 1.5) -> DataFrame:
    """Lower and upper bound per series from nearest-rank quartiles."""
    q = quantiles(df, s.id, col, {"q25": 0.25, "q75": 0.75}, method="nearest", spread=s.spread_over(df), join=s.attach)
    spread = F.lit(float(k)) * (F.col("q75") - F.col("q25"))
    return q.select(s.id, (F.col("q25") - spread).alias("_lower"), (F.col("q75") + spread).alias("_upper"))


def iqr_filter(df: DataFrame, s: Series = DAILY, col: str = "diff", k: float = 1.5) -> DataFrame:
    """Keep values up to the upper quartile plus ``k`` times the quartile distance of their series."""
    rows = s.attach(df, iqr_bounds(df, s, col, k))
    return rows.filter(F.col(col) <= F.col("_upper")).drop("_lower", "_upper")


def iqr_flag(df: DataFrame, s: Series = DAILY, col: str = "diff", k: float = 1.5) -> DataFrame:
    """Mark values outside the bounds on either side; rows are kept."""
    rows = spread_join(df, iqr_bounds(df, s, col, k), s.id, "left", by=s.time)
    outside = (F.col(col) > F.col("_upper")) | (F.col(col) < F.col("_lower"))
    return rows.withColumn("outlier", outside).drop("_lower", "_upper")


def outlier_share(flagged: DataFrame) -> DataFrame:
    """Number and percentage of marked rows."""
    hits = F.count(F.when(F.col("outlier"), 1))
    return flagged.agg(hits.alias("n_outliers"), (hits / F.count(F.lit(1)) * 100).alias("pct_outliers"))


def drop_flat_lines(df: DataFrame, s: Series = DAILY, thresh: int | None = None, col: str = "diff") -> DataFrame:
    """Delete runs of zeros longer than ``thresh``, keeping the value before the run.

    A run is everything from one non-zero value to the next. Zeros at the very start of a series have no value
    before them: their first zero is kept and the others are one fewer to count. Null rows are neither counted nor
    removed.
    """
    thresh = FLAT_LINE_LIMIT[s.step] if thresh is None else thresh
    value = F.col(col)
    rows = s.runs(df, value != 0, value, also={"_begin": (F.min(F.when(value.isNotNull(), F.col(s.time))), F.min)})
    first = (value != 0) | (F.col("_leading") & (F.col(s.time) == F.col("_begin")))
    keep = (F.col("_length") - 1 <= thresh) | value.isNull() | first
    return rows.filter(keep).select(*df.columns)


def drop_positive_jumps(df: DataFrame, s: Series = DAILY, factor: float = 50, col: str = "diff") -> DataFrame:
    """Keep values below ``factor`` times the median of their series; a median of zero deletes the series."""
    medians = quantiles(df, s.id, col, {"_median": 0.5}, spread=s.spread_over(df), join=s.attach).drop("n")
    rows = s.attach(df, medians)
    return rows.filter(F.col(col) < F.col("_median") * F.lit(factor)).drop("_median")


GRID_BLOCK = 4096


def explode_grid(rows: DataFrame, start: str, stop: Column, out: str, s: Series) -> DataFrame:
    """A row for each grid point from column ``start`` to ``stop``, or for ``start`` alone if that is not later.

    Long gaps are cut into blocks first, so that no row ever holds more than ``GRID_BLOCK`` points of one block.
    """
    wide = F.expr(f"interval {s.count * GRID_BLOCK} {s.step}")
    inner = F.expr(f"interval {s.count * (GRID_BLOCK - 1)} {s.step}")
    later = F.col("_stop") > F.col(start)
    rows = rows.withColumn("_stop", stop)
    rows = rows.withColumn("_block", F.explode(F.when(later, F.sequence(F.col(start), F.col("_stop"), wide)).otherwise(F.array(start))))
    last = F.least(F.col("_block") + inner, F.col("_stop"))
    points = F.when(later, F.sequence(F.col("_block"), last, s.interval)).otherwise(F.array("_block"))
    return rows.withColumn(out, F.explode(points)).drop("_stop", "_block")


def fill_grid(df: DataFrame, s: Series = DAILY, keep: Sequence[str] = ()) -> DataFrame:
    """Insert a row at every grid point between two readings; ``keep`` columns repeat, others are null."""
    rows = s.adjacent(df, [], previous=None, following="_next")
    rows = explode_grid(rows, s.time, F.col("_next")[s.time] - s.interval, "_point", s)
    own = F.col("_point") == F.col(s.time)
    fixed = {s.id, s.time, *keep}
    rows = rows.withColumns({c: F.when(own, F.col(c)) for c in df.columns if c not in fixed})
    return rows.withColumn(s.time, F.col("_point")).select(*df.columns)


def split_at_gaps(df: DataFrame, s: Series = DAILY, min_gap: int = 7, values: Sequence[str] = ("value", "diff")) -> DataFrame:
    """Split a series where at least ``min_gap`` consecutive grid points have no reading.

    Parts are numbered over all parts of a series and named ``<id>-<k>``; a part is kept only if its grid is longer
    than ``min_gap``. A series with one part keeps its id and all of its rows. Rows without any of ``values`` count
    as missing.

    A slice holds whole parts in its middle and pieces of parts at its ends; where those begin and end is known
    from the seam, so that the rows are shuffled once and no table of parts is needed.
    """
    past = Window.unboundedPreceding
    back = Window.partitionBy(s.id).orderBy(F.col(SLICE).desc()).rowsBetween(past, 0)
    whole = Window.partitionBy(s.id)
    piece = Window.partitionBy(s.id, SLICE, "_here")

    def breaks(earlier: Column, later: Column) -> Column:
        return F.coalesce((s.steps(earlier, later) - 1 >= min_gap).cast("long"), F.lit(0))

    gap = F.col("_gap") > 0
    entry, exits = F.col("_entry") > 0, F.coalesce(F.col("_exit") > 0, F.lit(True))
    opened = F.when(F.col("_gaps") > 0, F.col("_opens")).when(entry | F.col("_top").isNull(), F.col("_lo"))
    closed = F.when(F.col("_gaps") > 0, F.col("_closes")).when(exits, F.col("_hi"))
    rows = s.carry(
        df.dropna(how="all", subset=list(values)),
        {
            "_gaps": F.sum("_gap"),
            "_lo": F.min(s.time),
            "_hi": F.max(s.time),
            "_opens": F.max(F.when(gap, F.col(s.time))),  # start of the last piece
            "_closes": F.min(F.when(gap, F.col("_before"))),  # end of the first piece
        },
        {
            "_top": lambda w: F.lag("_hi").over(w),
            "_entry": lambda w: breaks(F.col("_top"), F.col("_lo")),
            "_exit": lambda w: F.lead("_entry").over(w),
            "_entries": lambda w: F.sum("_entry").over(w.rowsBetween(past, 0)),
            "_inner": lambda w: F.coalesce(F.sum("_gaps").over(w.rowsBetween(past, -1)), F.lit(0)),
            "_breaks": lambda w: F.sum(F.col("_gaps") + F.col("_entry")).over(whole),
            "_start": lambda w: F.when(entry | F.col("_top").isNull(), F.col("_lo")).otherwise(
                F.last(opened, True).over(w.rowsBetween(past, -1))
            ),
            "_first_end": lambda w: F.last(closed, True).over(back),
            "_end": lambda w: F.when(exits, F.col("_hi")).otherwise(F.lead("_first_end").over(w)),
            "_all": lambda w: F.col("_gaps"),
        },
        {
            "_before": lambda w: F.lag(s.time).over(w),
            "_gap": lambda w: breaks(F.col("_before"), F.col(s.time)),
            "_here": lambda w: F.sum("_gap").over(w.rowsBetween(past, 0)),
        },
    )
    first, last = F.col("_here") == 0, F.col("_here") == F.col("_all")
    start = F.when(first, F.col("_start")).otherwise(F.min(s.time).over(piece))
    end = F.when(last, F.col("_end")).otherwise(F.max(s.time).over(piece))
    rows = rows.withColumns({"_from": start, "_to": end})
    single = F.col("_breaks") == 0
    rows = rows.filter(single | (s.steps(F.col("_from"), F.col("_to")) + 1 > min_gap))
    part = F.col("_here") + F.col("_inner") + F.col("_entries")
    return rows.withColumn(s.id, F.when(single, F.col(s.id)).otherwise(F.concat_ws("-", s.id, part))).select(*df.columns)


def interpolate_linear(
    df: DataFrame, s: Series = DAILY, counter: str = "value", diff: str = "diff", keep: Sequence[str] = ("source",)
) -> DataFrame:
    """Fill the counter on the whole grid of a series and recompute the consumption from it.

    Between two known readings the counter is linear; outside them it keeps the nearest one. The first row keeps its
    recorded consumption. ``keep`` columns are constant in a series and repeat.
    """
    row = F.struct(s.time)
    c, t = F.col(counter), F.col(s.time)
    at = F.when(c.isNotNull(), t)
    seen = F.when(c.isNotNull(), F.struct(t.alias("time"), c.alias("value")))

    def edge(side: str) -> Column:
        pair = F.struct(F.col(f"{side}t").alias("time"), F.col(f"{side}v").alias("value"))
        return F.when(F.col(f"{side}t").isNotNull(), pair)

    back = Window.partitionBy(s.id, SLICE).orderBy(t.desc()).rowsBetween(Window.unboundedPreceding, -1)
    slices_back = Window.partitionBy(s.id).orderBy(F.col(SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    past = Window.unboundedPreceding
    rows = s.carry(
        df,
        {
            "_lt": F.max(at),
            "_lv": F.max_by(c, at),
            "_ft": F.min(at),
            "_fv": F.min_by(c, at),
            "_lo": F.min(t),
        },
        {
            "_k0": lambda w: F.last(edge("_l"), True).over(w.rowsBetween(past, -1)),
            "_k1": lambda w: F.last(edge("_f"), True).over(slices_back),
            "_n1": lambda w: F.lead("_lo").over(w),
            "_start": lambda w: F.min("_lo").over(Window.partitionBy(s.id)),
        },
        {
            "_p": lambda w: F.last(seen, True).over(w.rowsBetween(past, -1)),
            "_q": lambda w: F.last(seen, True).over(back),
            "_next": lambda w: F.lead(row).over(w),
        },
    )
    before, after = F.coalesce("_p", "_k0"), F.coalesce("_q", "_k1")
    own = F.when(c.isNotNull(), F.struct(t.alias("time"), c.alias("value")))
    stop = F.coalesce(F.col("_next")[s.time], F.col("_n1")) - s.interval
    rows = rows.select(
        s.id,
        *keep,
        t.alias("_t"),
        F.col(diff).alias("_diff"),
        "_start",
        own.alias("_own"),
        before.alias("_a"),
        after.alias("_b"),
        stop.alias("_until"),
    )
    rows = explode_grid(rows, "_t", F.col("_until"), s.time, s).drop("_until")
    at_row = F.col(s.time) == F.col("_t")
    # the last known reading before a grid point, and the first known one at or after it
    low = F.when(at_row, F.col("_a")).otherwise(F.coalesce("_own", "_a"))
    high = F.when(at_row, F.coalesce("_own", "_b")).otherwise(F.col("_b"))
    rows = rows.withColumns({"_low": low, "_high": high})
    length = s.epoch(F.col("_high.time")) - s.epoch(F.col("_low.time"))
    rise = F.col("_high.value") - F.col("_low.value")
    value = F.when(at_row & F.col("_own").isNotNull(), F.col("_own.value")).otherwise(
        F.coalesce(
            F.col("_low.value") + rise * (s.epoch(F.col(s.time)) - s.epoch(F.col("_low.time"))) / length,
            F.col("_low.value"),
            F.col("_high.value"),
        )
    )
    step = F.coalesce(rise * s.seconds / length, F.when(value.isNotNull(), F.lit(0.0)))
    first = F.col(s.time) == F.col("_start")
    return rows.select(
        s.id, s.time, value.alias(counter), F.when(first, F.col("_diff")).otherwise(step).alias(diff), *keep
    )


def ffill(df: DataFrame, cols: Sequence[str], s: Series = DAILY) -> DataFrame:
    """Replace null by the last earlier value of the same series."""
    rows, past = df, Window.unboundedPreceding

    def last_known(c: str) -> Column:
        return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(s.time)))

    rows = s.carry(
        df,
        {f"_l_{c}": last_known(c) for c in cols},
        {
            f"_s_{c}": (lambda w, c=c: F.last(f"_l_{c}", True).over(w.rowsBetween(past, -1)))
            for c in cols
        },
        {f"_w_{c}": (lambda w, c=c: F.last(c, True).over(w.rowsBetween(past, 0))) for c in cols},
    )
    filled = {c: F.coalesce(f"_w_{c}", f"_s_{c}") for c in cols}
    return rows.withColumns(filled).select(*df.columns)


def active_range(df: DataFrame, col: str, s: Series = DAILY, default: float = 0.0) -> DataFrame:
    """Trim a series to its first and last known value; nulls in between become ``default``."""
    seen = F.when(F.col(col).isNotNull(), F.col(s.time))
    rows = s.totals(df, {"_lo": (F.min(seen), F.min), "_hi": (F.max(seen), F.max)})
    rows = rows.filter(F.col(s.time).between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")
    return rows.withColumn(col, F.coalesce(col, F.lit(default)))


def resample_last(
    df: DataFrame,
    keys: Sequence[str],
    value: str = "unit_sales",
    s: Series = Series("day", id="traj_id", time="date"),
    flag: str = "open",
    log: str = "log_sales",
) -> DataFrame:
    """Daily grid per series with the last row of each day.

    ``keys`` are forward-filled, ``flag`` is 1 on days with a row and 0 on inserted days, ``value`` and its
    logarithm stay null there; the logarithm of zero is minus infinity.
    """
    day = F.date_trunc("day", F.col(s.time)).cast(df.schema[s.time].dataType)
    cols = [c for c in df.columns if c not in (s.id, s.time)]
    # the last non-null value of each column on a day
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(s.time))).alias(c) for c in cols]
    daily = df.groupBy(s.id, day.alias(s.time)).agg(*last).withColumn(flag, F.lit(1))
    grid = fill_grid(ffill(daily, keys, s), s, keep=keys)
    return grid.withColumns(
        {
            flag: F.coalesce(flag, F.lit(0)),
            log: F.when(F.col(value) == 0, F.lit(float("-inf"))).otherwise(F.ln(value)),
        }
    )


def prev_next(df: DataFrame, col: str = "values", s: Series = DAILY) -> DataFrame:
    """Previous and next value of the series; rows with a null anywhere are dropped."""
    rows = s.adjacent(df, [col], previous="_prev", following="_next")
    rows = rows.withColumns({f"prev_{col}": F.col("_prev")[col], f"next_{col}": F.col("_next")[col]})
    return rows.drop("_prev", "_next").dropna()
