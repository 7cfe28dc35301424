"""Row order inside a series without putting a whole series into one task.

One series may hold a large share of all rows, so no window here is partitioned by the series id alone. A series is
cut into time slices of at most ``points`` grid steps. Work inside a slice is an ordinary window over
``(id, slice)``; what has to cross a slice border (the previous row, a running sum, the last known value) is carried
by a *seam* table with one row per slice, which is joined back on ``(id, slice)``, the partitioning the rows
already have. The seam is thousands of times smaller than the rows.

Offsets of more than one row use ``neighbours``: rows are numbered, cut into runs of ``chunk`` consecutive rows, and
each run gets copies of the rows next to it.

A series has one row per id and time, so a slice holds at most ``points`` rows; where rows meet their neighbours a repeated time
is an error, as is a session in a time zone whose days do not all have 24 hours. ``id`` is never null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from heatloom.functions.skew import is_small, is_tiny, shuffled_join, spread_join
from heatloom.functions.tables import store_buckets

SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
SLICE = "_slice"


@lru_cache
def even_days(zone: str) -> bool:
    """Whether the offset of a time zone never changes; names that are no region are offsets."""
    try:
        region = ZoneInfo(zone)
    except (ZoneInfoNotFoundError, ValueError):
        return True
    return len({datetime(y, m, 1, tzinfo=region).utcoffset() for y in range(1990, 2040) for m in range(1, 13)}) == 1


@dataclass(frozen=True)
class Series:
    """Which columns make up a series and how wide its grid step is."""

    step: str = "day"
    id: str = "id"
    time: str = "datetime"
    count: int = 1
    points: int = 8192
    chunk: int = 8192
    _seconds: int = field(init=False, repr=False, default=0)

    def __post_init__(self):
        if self.step not in SECONDS:
            raise ValueError(f"unknown step {self.step!r}; one of {sorted(SECONDS)}")
        object.__setattr__(self, "_seconds", SECONDS[self.step] * self.count)

    @property
    def seconds(self) -> int:
        return self._seconds

    @property
    def interval(self) -> Column:
        return F.expr(f"interval {self.count} {self.step}")

    @property
    def ascending(self) -> Column:
        return F.col(self.time).asc()

    def epoch(self, column: Column | str | None = None) -> Column:
        """Seconds since the epoch; sessions run in UTC so that days have 86 400 of them."""
        c = F.col(self.time) if column is None else (F.col(column) if isinstance(column, str) else column)
        return c.cast("timestamp").cast("long")

    def steps(self, earlier: Column, later: Column) -> Column:
        """Whole grid steps between two times."""
        return F.floor((self.epoch(later) - self.epoch(earlier)) / F.lit(self.seconds)).cast("long")

    def sliced(self, df: DataFrame) -> DataFrame:
        if SLICE in df.columns:  # laid out already
            return df
        zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
        if not even_days(zone):
            raise ValueError(f"series need days of 24 hours, as in UTC; this session is in {zone}")
        return df.withColumn(SLICE, F.floor(self.epoch() / F.lit(self.seconds * self.points)).cast("long"))

    def laid_out(self, df: DataFrame, dealt: bool = False) -> DataFrame:
        """``df`` stored by series and slice, in time order, with its slice as a column that operators keep.

        Windows inside slices and the joins of seams then take the rows where they lie: what follows shuffles seams, never rows. Rows that come
        from a window inside slices are ``dealt`` out like that already.
        """
        return store_buckets(self.sliced(df), [self.id, SLICE], [self.id, SLICE, self.time], dealt=dealt)

    def spread_over(self, df: DataFrame) -> list[str]:
        """Columns that tell where in a series a row is."""
        return [self.time, SLICE] if SLICE in df.columns else [self.time]

    def attach(self, df: DataFrame, dim: DataFrame) -> DataFrame:
        """Rows of ``df`` with the columns of ``dim``, which has one row per series; series without one are left out.

        Rows that are laid out stay where they are: ``dim`` is first joined to the slices of each series, which are few, and then to the rows
        on series and slice. Other rows are spread over salts.
        """
        if SLICE not in df.columns or is_small(dim):
            return spread_join(df, dim, self.id, "inner", by=self.time)
        slices = shuffled_join(df.select(self.id, SLICE).distinct(), dim, [self.id], "inner")
        return df.join(slices, [self.id, SLICE])

    def unsliced(self, out: DataFrame, df: DataFrame) -> DataFrame:
        """``out`` with a slice column only if ``df``, which it was made of, has one."""
        return out if SLICE in df.columns else out.drop(SLICE)

    @property
    def inside(self) -> WindowSpec:
        return Window.partitionBy(self.id, SLICE).orderBy(self.time)

    def carry(
        self,
        df: DataFrame,
        per_slice: dict[str, Column],
        across: dict[str, Callable[[WindowSpec], Column]],
        inside: dict[str, Callable[[WindowSpec], Column]] | None = None,
    ) -> DataFrame:
        """Rows of ``df`` with ``inside`` window columns and the ``across`` columns of their slice.

        ``inside`` columns are made in order, each from the window of one slice, and may use earlier ones.
        ``per_slice`` are aggregates of one slice, which may use ``inside`` columns; ``across`` columns are made in
        order from the window of all slices of a series.
        """
        rows = self.sliced(df)
        for name, make in (inside or {}).items():
            rows = rows.withColumn(name, make(self.inside))
        seam = rows.groupBy(self.id, SLICE).agg(*[c.alias(name) for name, c in per_slice.items()])
        slices = Window.partitionBy(self.id).orderBy(SLICE)
        for name, make in across.items():
            seam = seam.withColumn(name, make(slices))
        seam = seam.select(self.id, SLICE, *across)  # may have as many rows as there are
        if is_tiny(df):
            return rows.join(seam, [self.id, SLICE], "left")
        return shuffled_join(rows, seam, [self.id, SLICE], "left")

    def adjacent(
        self, df: DataFrame, cols: list[str], previous: str | None = "_prev", following: str | None = None
    ) -> DataFrame:
        """The previous / following row of the same series as a struct of time and ``cols`` (null at the ends)."""
        row = F.struct(self.time, *cols)
        # plain columns per slice rather than structs: they aggregate in a hash table, without sorting the rows
        edge = lambda side: F.struct(*[F.col(f"_{side}{i}").alias(c) for i, c in enumerate([self.time, *cols])])
        per_slice, across, inside = {}, {}, {}
        if previous:
            per_slice["_last0"] = F.max(self.time)
            per_slice |= {f"_last{i}": F.max_by(c, self.time) for i, c in enumerate(cols, 1)}
            across["_before"] = lambda w: F.lag(edge("last")).over(w)
            inside[previous] = lambda w: F.lag(row).over(w)
        if following:
            per_slice["_first0"] = F.min(self.time)
            per_slice |= {f"_first{i}": F.min_by(c, self.time) for i, c in enumerate(cols, 1)}
            across["_after"] = lambda w: F.lead(edge("first")).over(w)
            inside[following] = lambda w: F.lead(row).over(w)
        out = self.carry(df, per_slice, across, inside)
        if previous:
            out = out.withColumn(previous, F.coalesce(self.once(F.col(previous)), F.col("_before"))).drop("_before")
        if following:
            out = out.withColumn(following, F.coalesce(self.once(F.col(following)), F.col("_after"))).drop("_after")
        return self.unsliced(out, df)

    def twice(self) -> Column:
        return F.raise_error(F.concat(F.lit("two rows at "), F.col(self.time).cast("string"), F.lit(" in series "), F.col(self.id).cast("string")))

    def once(self, neighbour: Column) -> Column:
        """``neighbour`` (a struct with the time), or an error if that row has the same time as this one."""
        return F.when(neighbour[self.time] == F.col(self.time), F.when(self.twice().isNull(), neighbour)).otherwise(neighbour)

    def numbered(self, df: DataFrame, position: str = "_pos", total: str = "_total") -> DataFrame:
        """Zero-based position of each row in its series and the length of the series."""
        out = self.carry(
            df,
            {"_n": F.count(F.lit(1))},
            {
                "_offset": lambda w: F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                total: lambda w: F.sum("_n").over(Window.partitionBy(self.id)),
            },
            {position: lambda w: F.row_number().over(w), "_earlier": lambda w: F.lag(self.time).over(w)},
        )
        again = F.when(F.col("_earlier") == F.col(self.time), self.twice().cast("long"))
        place = F.col(position).cast("long") - 1 + F.coalesce("_offset", F.lit(0)) + F.coalesce(again, F.lit(0))
        return self.unsliced(out.withColumn(position, place).drop("_offset", "_earlier"), df)

    def totals(self, df: DataFrame, aggregates: dict[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
        """Attach aggregates of the whole series; each is given as (per-slice aggregate, how slices combine)."""
        whole = Window.partitionBy(self.id)
        out = self.carry(
            df,
            {f"_{name}": first for name, (first, _) in aggregates.items()},
            {
                name: (lambda w, name=name, combine=combine: combine(F.col(f"_{name}")).over(whole))
                for name, (_, combine) in aggregates.items()
            },
        )
        return self.unsliced(out, df)

    def running_sum(self, df: DataFrame, col: str, out: str) -> DataFrame:
        """Cumulative sum in time order, null counted as zero."""
        value = F.coalesce(F.col(col), F.lit(0))
        rows = self.carry(
            df,
            {"_sum": F.sum(value)},
            {"_offset": lambda w: F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1))},
            {out: lambda w: F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))},
        )
        return self.unsliced(rows.withColumn(out, F.col(out) + F.coalesce("_offset", F.lit(0))).drop("_offset"), df)

    def known(self, df: DataFrame, value: Column, before: str | None = None, after: str | None = None) -> DataFrame:
        """Nearest rows strictly before / after a row at which ``value`` is not null, as struct (time, value)."""
        at = F.when(value.isNotNull(), F.col(self.time))
        seen = F.when(value.isNotNull(), F.struct(F.col(self.time).alias("time"), value.alias("value")))
        per_slice, across, inside = {}, {}, {}

        def edge(side: str) -> Column:
            pair = F.struct(F.col(f"_{side}0").alias("time"), F.col(f"_{side}1").alias("value"))
            return F.when(F.col(f"_{side}0").isNotNull(), pair)

        if before:
            per_slice["_last0"], per_slice["_last1"] = F.max(at), F.max_by(value, at)
            across["_before"] = lambda w: F.last(edge("last"), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
            inside[before] = lambda w: F.last(seen, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        if after:
            per_slice["_first0"], per_slice["_first1"] = F.min(at), F.min_by(value, at)
            # read backwards, so that the frame only grows from one row to the next
            slices = Window.partitionBy(self.id).orderBy(F.col(SLICE).desc())
            rows = Window.partitionBy(self.id, SLICE).orderBy(F.col(self.time).desc())
            across["_after"] = lambda w: F.last(edge("first"), True).over(slices.rowsBetween(Window.unboundedPreceding, -1))
            inside[after] = lambda w: F.last(seen, True).over(rows.rowsBetween(Window.unboundedPreceding, -1))
        out = self.carry(df, per_slice, across, inside)
        if before:
            out = out.withColumn(before, F.coalesce(before, "_before")).drop("_before")
        if after:
            out = out.withColumn(after, F.coalesce(after, "_after")).drop("_after")
        return self.unsliced(out, df)

    def runs(
        self,
        df: DataFrame,
        begins: Column,
        counted: Column,
        also: dict[str, tuple[Column, Callable[[Column], Column]]] | None = None,
    ) -> DataFrame:
        """Runs from one row at which ``begins`` is true to the next: ``_length``, the number of rows of the run at which ``counted`` is
        not null, and ``_leading``, whether it is the run before the first such row. ``also`` are aggregates of the series, as in ``totals``.

        A slice is summed up by the counts of its run that is open at the front, of the one open at the back (the same if none
        begins in it) and whether one begins. Such summaries combine: a run over several slices is a back, whole slices, a front, which
        are added up over the seam. Rows are shuffled once and joined to the seam only.
        """
        past, also = Window.unboundedPreceding, also or {}
        move = F.coalesce(begins.cast("long"), F.lit(0))
        whole, slice_ = Window.partitionBy(self.id), Window.partitionBy(self.id, SLICE)
        opens = F.col("_moves") > 0
        out = self.carry(
            df,
            {
                "_moves": F.max("_here"),
                "_front": F.count(F.when(F.col("_here") == 0, counted)),
                "_back": F.count(F.when(F.col("_here") == F.col("_last"), counted)),
                **{f"_{name}": first for name, (first, _) in also.items()},
            },
            {
                # slices with the same number of earlier slices in which a run begins have the same run open at their front
                "_class": lambda w: F.coalesce(F.sum(opens.cast("long")).over(w.rowsBetween(past, -1)), F.lit(0)),
                "_before": lambda w: F.coalesce(F.last(F.when(opens, F.col("_back")), True).over(w.rowsBetween(past, -1)), F.lit(0)),
                "_enters": lambda w: F.sum("_front").over(Window.partitionBy(self.id, "_class")) + F.col("_before"),
                "_leaves": lambda w: F.coalesce(F.lead("_enters").over(w), F.col("_back")),
                **{name: (lambda w, name=name, combine=combine: combine(F.col(f"_{name}")).over(whole)) for name, (_, combine) in also.items()},
            },
            {
                "_here": lambda w: F.sum(move).over(w.rowsBetween(past, 0)),
                "_last": lambda w: F.max("_here").over(slice_),
            },
        )
        inner = F.count(counted).over(Window.partitionBy(self.id, SLICE, "_here"))
        front, back = F.col("_here") == 0, F.col("_here") == F.col("_last")
        out = out.withColumn("_length", F.when(front, F.col("_enters")).when(back, F.col("_leaves")).otherwise(inner))
        out = out.withColumn("_leading", front & (F.col("_class") == 0))
        return self.unsliced(out.drop("_here", "_last", "_class", "_before", "_enters", "_leaves"), df)

    def neighbours(
        self, df: DataFrame, before: int, after: int, columns: Callable[[WindowSpec], dict[str, Column]]
    ) -> DataFrame:
        """Window columns that look at most ``before`` rows back and ``after`` rows ahead.

        Rows are cut into runs of ``chunk`` consecutive rows of a series; rows next to a run are copied into it
        and dropped again after the window. The copies are ``(before + after) / chunk`` of the input.
        """
        size = max(self.chunk, before, after, 1)
        at, total = F.col("_pos") % size, F.col("_total")
        run = ((F.col("_pos") - at) / size).cast("long")
        to_next = (at >= size - before) & (F.col("_pos") - at + size < total)
        to_last = (at < after) & (run > 0)
        # literal arrays per case compile to plain code; most rows have no copy
        copies = (
            F.when(to_next & to_last, F.array(run, run + 1, run - 1))
            .when(to_next, F.array(run, run + 1))
            .when(to_last, F.array(run, run - 1))
            .otherwise(F.array(run))
        )
        rows = self.numbered(df).withColumn("_run", F.explode(copies))
        w = Window.partitionBy(self.id, "_run").orderBy("_pos")
        rows = rows.withColumn("_own", F.col("_run") == run).withColumns(columns(w))
        return rows.filter("_own").drop("_own", "_run", "_pos", "_total")


DAILY = Series("day")
HOURLY = Series("hour")
