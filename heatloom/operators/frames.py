"""Lags, supervised frames, windows and tensors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heatloom.functions.order import hash_order, sorted_offset
from heatloom.functions.series import DAILY, SLICE, Series
from heatloom.schema import MASKING_VALUE, Role, check_roles, column_roles, column_with_role


def past(col: str, i: int) -> str:
    return f"{col}(t-{i})"


def ahead(col: str, i: int) -> str:
    return f"{col}(t+{i})" if i else col


def lag_lead_columns(df: DataFrame, lag_in: int, lag_out: int, s: Series = DAILY, col: str = "diff") -> DataFrame:
    """The ``lag_in`` previous and ``lag_out`` - 1 following values of ``col`` as columns."""

    def columns(w) -> dict[str, Column]:
        lags = {past(col, i): F.lag(col, i).over(w) for i in range(1, lag_in + 1)}
        return {**lags, **{ahead(col, i): F.lead(col, i).over(w) for i in range(1, lag_out)}}

    return s.neighbours(df, lag_in, max(lag_out - 1, 0), columns)


def lag_any_column(
    df: DataFrame, cols: Sequence[str] | str, n: int, s: Series = DAILY, name: str = "{col}_lag_{i}"
) -> DataFrame:
    """``n`` lags of one or several columns; fewer than one is an error."""
    if n < 1:
        raise ValueError("n must be at least 1")
    cols = [cols] if isinstance(cols, str) else list(cols)
    return s.neighbours(
        df, n, 0, lambda w: {name.format(col=c, i=i): F.lag(c, i).over(w) for c in cols for i in range(1, n + 1)}
    )


def drop_incomplete_lags(df: DataFrame, n_in: int, n_out: int, col: str = "diff") -> DataFrame:
    """Drop rows that lack one of the lags or leads a window needs."""
    needed = [past(col, i) for i in range(1, n_in + 1)] + [ahead(col, i) for i in range(1, n_out)]
    present = F.lit(True)
    for c in needed:
        present = present & F.col(f"`{c}`").isNotNull()
    return df.filter(present)


def future_covariates(
    df: DataFrame, cols: Sequence[str], n_out: int, s: Series = DAILY, target: str = "diff"
) -> DataFrame:
    """Following values of covariates and of the target, up to ``n_out`` - 1 steps, named ``<col>_t+<i>``."""
    names = [target, *[c for c in cols if c != target]]
    return s.neighbours(
        df, 0, n_out - 1, lambda w: {f"{c}_t+{i}": F.lead(c, i).over(w) for c in names for i in range(1, n_out)}
    )


def last_n_diffs(df: DataFrame, n: int, s: Series = DAILY, col: str = "diff") -> DataFrame:
    """The ``n`` previous values as columns ``t-n`` … ``t-1``; rows without ``n`` predecessors are dropped."""
    rows = s.neighbours(
        df,
        n,
        0,
        lambda w: {
            **{f"t-{i}": F.lag(col, i).over(w) for i in range(n, 0, -1)},
            "_complete": F.lag(F.lit(True), n).over(w),
        },
    )
    return rows.filter(F.col("_complete") & F.col(col).isNotNull()).drop("_complete")


def supervised_frame(
    df: DataFrame, cols: Sequence[str], lag_in: int, lag_out: int, s: Series = DAILY, dropnan: bool = True
) -> DataFrame:
    """Per row the window of ``cols`` from ``lag_in`` steps back to ``lag_out`` - 1 steps ahead.

    ``steps`` is an array of structs, oldest first; the row itself is at index ``lag_in``. Rows whose window is cut
    off by the ends of the series, or holds a null, are dropped with ``dropnan``; without it only complete windows
    remain but they may hold nulls.
    """

    full = F.lit(True)
    for c in cols:
        full = full & F.col(c).isNotNull()

    def columns(w) -> dict[str, Column]:
        frame = w.rowsBetween(-lag_in, lag_out - 1)
        return {"steps": F.collect_list(F.struct(*cols)).over(frame), "_full": F.count(F.when(full, 1)).over(frame)}

    total = lag_in + lag_out
    rows = s.neighbours(df.select(s.id, s.time, *cols), lag_in, lag_out - 1, columns)
    rows = rows.filter((F.col("_full") if dropnan else F.size("steps")) == total)
    return rows.select(s.id, s.time, "steps")


def wide(df: DataFrame, cols: Sequence[str], lag_in: int, lag_out: int) -> DataFrame:
    """Supervised frame with one column per feature and step, for tools that need flat columns."""
    flat = []
    for i in range(lag_in + lag_out):
        for c in cols:
            name = past(c, lag_in - i) if i < lag_in else ahead(c, i - lag_in)
            flat.append(F.col("steps")[i][c].alias(name))
    return df.select(*[c for c in df.columns if c != "steps"], *flat)


def supervised_legacy(
    df: DataFrame,
    cols: Sequence[str],
    n_in: int,
    n_out: int,
    n_future: int,
    past_diffs: bool = True,
    s: Series = DAILY,
    pad: float = MASKING_VALUE,
) -> DataFrame:
    """Inputs ``x`` (steps × features) and outputs ``y`` of the older framing; the first of ``cols`` is the target.

    ``x`` holds ``n_in`` past and ``n_future`` following steps; in the following ones the target is ``pad``. Without
    ``past_diffs`` the target is left out of ``x`` altogether.
    """
    if n_future > n_out:
        raise ValueError("n_future can not be larger than n_out")
    target = cols[0]
    rows = supervised_frame(df, cols, n_in, n_out, s)

    def step(x: Column, i: Column) -> Column:
        hidden = F.when(i < n_in, x[target].cast("double")).otherwise(F.lit(float(pad)))
        values = [hidden] if past_diffs else []
        return F.array(*values, *[x[c].cast("double") for c in cols[1:]])

    x = F.transform(F.slice("steps", 1, n_in + n_future), step)
    y = F.transform(F.slice("steps", n_in + 1, n_out), lambda r: r[target])
    return rows.select(s.id, s.time, x.alias("x"), y.alias("y"))


def legacy_lengths(frame: DataFrame, id_col: str = "id") -> DataFrame:
    """Number of samples of each series."""
    return frame.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))


def xy_split(
    frame: DataFrame,
    cols: Sequence[str],
    lag_in: int,
    n_in: int,
    n_out: int,
    n_future: int,
    target: str = "diff",
) -> DataFrame:
    """Flat inputs and outputs of a supervised frame.

    ``x`` lists the last ``n_in`` steps, time by time, then ``n_future`` steps from the current one on without the
    target; ``y`` are the next ``n_out`` target values.
    """
    recent = F.slice("steps", lag_in - n_in + 1, n_in)
    x = F.flatten(F.transform(recent, lambda r: F.array(*[r[c].cast("double") for c in cols])))
    covariates = [c for c in cols if c != target]
    if n_future and covariates:
        coming = F.slice("steps", lag_in + 1, n_future)
        x = F.concat(x, F.flatten(F.transform(coming, lambda r: F.array(*[r[c].cast("double") for c in covariates]))))
    y = F.transform(F.slice("steps", lag_in + 1, n_out), lambda r: r[target].cast("double"))
    return frame.select(*[c for c in frame.columns if c != "steps"], x.alias("x"), y.alias("y"))


def mask_future_target(
    frame: DataFrame, lag_in: int, target: str = "diff", value: float = MASKING_VALUE
) -> DataFrame:
    """Replace the target from the current step on by ``value``; sequence models keep the column."""
    hidden = F.transform(
        "steps", lambda r, i: r.withField(target, F.when(i < lag_in, r[target]).otherwise(F.lit(float(value))))
    )
    return frame.withColumn("steps", hidden)


def tensor_3d(
    frame: DataFrame,
    cols: Sequence[str],
    lag_in: int,
    n_in: int,
    n_out: int,
    n_future: int,
    target: str = "diff",
    value: float = MASKING_VALUE,
) -> DataFrame:
    """Inputs as ``[timesteps, features]`` per sample with the coming target masked, and outputs ``y``."""
    y = F.transform(F.slice("steps", lag_in + 1, n_out), lambda r: r[target].cast("double"))
    masked = mask_future_target(frame.withColumn("y", y), lag_in, target, value)
    kept = F.slice("steps", lag_in - n_in + 1, n_in + n_future)
    x = F.transform(kept, lambda r: F.array(*[r[c].cast("double") for c in cols]))
    return masked.select(*[c for c in frame.columns if c != "steps"], x.alias("x"), "y")


def past_future_parts(
    tensor: DataFrame, n_in: int, cols: Sequence[str], target: str = "diff"
) -> DataFrame:
    """Split a tensor into its past and future steps; the masked target is removed from the future."""
    at = list(cols).index(target)
    steps = F.size("x") - n_in
    future = F.transform(F.slice("x", F.lit(n_in + 1), steps), lambda r: F.filter(r, lambda _, j: j != at))
    return tensor.select(
        *[c for c in tensor.columns if c != "x"], F.slice("x", 1, n_in).alias("past"), future.alias("future")
    )


#: Positions in a block, at least, when windows gather their rows.
WINDOW_BLOCK = 64


def sliding_windows(
    df: DataFrame,
    roles: Sequence[Role],
    total: int,
    encoder: int,
    step: str = "day",
    s: Series | None = None,
) -> DataFrame:
    """Every window of ``total`` consecutive rows of a series, for a role-declared dataset.

    ``inputs`` are all input columns in role order per step, ``outputs`` the target after the first ``encoder``
    steps, ``time`` and ``identifier`` run along, ``active_entries`` weighs every output with one. Series shorter
    than a window give none.
    """
    check_roles(list(roles))
    id_col, time, target = (column_with_role(list(roles), r) for r in ("id", "time", "target"))
    inputs = [r.name for r in column_roles(list(roles)) if r.role not in ("id", "time")]
    s = s or Series(step, id=id_col, time=time)
    base = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([id_col, s.id, s.time, time, *inputs])])

    def columns(w) -> dict[str, Column]:
        parts = F.struct(F.col(time).alias("_t"), *[F.col(f"`{c}`").cast("double").alias(c) for c in inputs])
        return {"_rows": F.collect_list(parts).over(w.rowsBetween(0, total - 1))}

    rows = s.neighbours(base, 0, total - 1, columns).filter(F.size("_rows") == total)
    return _window_columns(rows, [id_col, s.id], inputs, target, total, encoder)


def _window_columns(rows: DataFrame, ids: Sequence[str], inputs: Sequence[str], target: str, total: int, encoder: int) -> DataFrame:
    """The columns of windows from their rows (``_rows``: time ``_t`` and inputs, in order)."""
    decoder = F.slice("_rows", encoder + 1, total - encoder)
    return rows.select(
        *dict.fromkeys(ids),
        F.col("_rows")[0]["_t"].alias("window_start"),
        F.transform("_rows", lambda r: F.array(*[r[c] for c in inputs])).alias("inputs"),
        F.transform(decoder, lambda r: r[target]).alias("outputs"),
        F.transform(decoder, lambda r: F.lit(1.0)).alias("active_entries"),
        F.transform("_rows", lambda r: r["_t"]).alias("time"),
        F.array_repeat(F.col(ids[0]), total).alias("identifier"),
    )


def sampled_windows(
    df: DataFrame,
    roles: Sequence[Role],
    total: int,
    encoder: int,
    m: int,
    seed: int = 42,
    step: str = "day",
    s: Series | None = None,
) -> DataFrame:
    """At most ``m`` of the windows, chosen without replacement by a seeded hash of their first row.

    Windows are chosen among their first rows, which are narrow, and then gather the rows they cover: a row is joined to the chosen windows of
    its series that reach its block of positions, so only rows inside the sample ever meet in an array.
    """
    if m < 1:
        raise ValueError("m must be at least 1")
    check_roles(list(roles))
    id_col, time, target = (column_with_role(list(roles), r) for r in ("id", "time", "target"))
    inputs = [r.name for r in column_roles(list(roles)) if r.role not in ("id", "time")]
    s = s or Series(step, id=id_col, time=time)
    starts = s.numbered(df.select(*dict.fromkeys([id_col, s.id, s.time]))).filter(F.col("_pos") + total <= F.col("_total"))
    starts = starts.select(*dict.fromkeys([id_col, s.id]), F.col(s.time).alias("window_start"), F.col("_pos").alias("_first"))
    chosen = hash_order(starts, [id_col, "window_start"], seed).filter(F.col("_rank") < m).select(s.id, "_first")
    size = max(total, WINDOW_BLOCK)
    block = lambda at: F.floor(at / F.lit(size))
    reach = chosen.withColumn("_block", F.explode(F.sequence(block(F.col("_first")), block(F.col("_first") + total - 1))))
    base = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([id_col, s.id, s.time, time, *inputs])])
    rows = s.numbered(base).withColumn("_block", block(F.col("_pos"))).join(reach, [s.id, "_block"])
    rows = rows.filter((F.col("_pos") >= F.col("_first")) & (F.col("_pos") < F.col("_first") + total))
    parts = F.struct("_pos", F.col(time).alias("_t"), *[F.col(f"`{c}`").cast("double").alias(c) for c in inputs])
    windows = rows.groupBy(*dict.fromkeys([s.id, id_col]), "_first").agg(F.array_sort(F.collect_list(parts)).alias("_rows"))
    return _window_columns(windows, [id_col, s.id], inputs, target, total, encoder)


def row_index(df: DataFrame, s: Series = DAILY) -> DataFrame:
    """Position of each row in its series (``b_idx``) and in the order of id and time (``index``).

    The global position adds what comes before the series; only one row per series is put in global order.
    """
    sizes = df.groupBy(s.id).agg(F.count(F.lit(1)).alias("_n"))
    before = sorted_offset(sizes, [s.id], F.col("_n"), "_before").select(s.id, "_before")
    counts = s.sliced(df).select(s.id, SLICE).distinct()
    # the offset reaches the rows by series and slice, which keeps a long series spread out
    before = counts.join(before, s.id)
    rows = s.sliced(s.numbered(df, "b_idx")).join(before, [s.id, SLICE])
    return rows.withColumn("index", F.col("_before") + F.col("b_idx")).drop("_before", "_total", SLICE)
