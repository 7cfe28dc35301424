"""Exact order statistics and global positions without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatloom.functions.skew import spread_join
from heatloom.functions.tables import materialize

CELLS = 4096  # parts of equal width that the values between two edges of a bracket are ranked in
BUCKETS = 65536  # values of the leading four hexadecimal digits of a hash


def _linear(n: Column, p: float) -> tuple[Column, Column, Column]:
    place = (n - 1) * F.lit(float(p))
    low = F.floor(place)
    return low + 1, F.ceil(place) + 1, place - low


def _nearest(n: Column, p: float) -> tuple[Column, Column, Column]:
    rank = F.floor((n - 1) * F.lit(float(p)) + F.lit(0.5)) + 1
    return rank, rank, F.lit(0.0)


METHODS: dict[str, Callable] = {"linear": _linear, "nearest": _nearest}


def quantiles(
    df: DataFrame,
    by: list[str] | str,
    col: str,
    probs: dict[str, float],
    method: str = "linear",
    accuracy: int = 10_000,
    few_groups: bool = False,
    spread: list[str] | str | None = None,
    also: dict[str, Column] | None = None,
    join: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Exact quantiles of ``col`` per group, one output column per entry of ``probs``; nulls are ignored.

    The built-in exact percentile keeps all distinct values of a group in one buffer. Here a first scan makes a mergeable sketch that
    brackets each wanted rank. A second scan counts: values outside the brackets by zone, the few inside by value, both before anything
    is shuffled, so what is shuffled are counts. They are ranked cell by cell, so neither a hot group nor the size of the table puts a whole
    bracket into one task. If a rank were ever outside its bracket the query fails rather than returning a neighbour.

    ``also`` are further aggregates of each group (``by`` is not empty), made by the first scan; with them, groups without any value have a row as well. Where groups
    are too many for their brackets to be handed to the rows as they are, rows are spread within a group by ``spread``, columns that vary
    there (by default the value), or brought together by ``join``, which sees these columns. Without ``by``, or where the caller knows that there are only a few groups (columns, splits), brackets are
    always handed over and no row is shuffled.
    """
    by = [by] if isinstance(by, str) else list(by)
    spread = ["_v"] if spread is None else [spread] if isinstance(spread, str) else list(spread)
    value = F.col(col).cast("double")
    firsts = df.groupBy(*by).agg(*_brackets(value, probs, accuracy), *[c.alias(name) for name, c in (also or {}).items()])
    if also:  # used twice
        firsts = materialize(firsts)
    extra = [c for c in spread if c not in (*by, "_v")]
    rows = df.select(*by, *extra, value.alias("_v")).filter(F.col("_v").isNotNull())
    if not by:
        whole = firsts.select(F.struct("_n", "_edges")).scalar()
        marked = rows.withColumn("_s", whole).select("_v", "_s._n", "_s._edges")
    elif few_groups:
        marked = rows.join(F.broadcast(firsts.select(*by, "_n", "_edges")), by)
    elif join:
        marked = join(rows, firsts.select(*by, "_n", "_edges"))
    else:
        marked = spread_join(rows, firsts.select(*by, "_n", "_edges"), by, "inner", by=spread)
    found = _selected(marked, by, probs, method)
    if not also:
        return found
    more = firsts.select(*by, *also)
    return more.join(F.broadcast(found), by, "left") if few_groups else more.join(found, by, "left")


def column_quantiles(df: DataFrame, cols: list[str], probs: dict[str, float], method: str = "linear", accuracy: int = 10_000, also: dict[str, Callable] | None = None) -> DataFrame:
    """Exact quantiles of several columns, one row per ``column``, and further aggregates of each: functions of its name.

    All columns share the first scan, without a row per value; in the second a value only makes a row inside its task, where it is counted.
    """
    also = also or {}
    parts = []
    for i, c in enumerate(cols):
        parts += [x.alias(f"_{name}{i}") for x, name in zip(_brackets(F.col(f"`{c}`").cast("double"), probs, accuracy), ("n", "edges"), strict=True)]
        parts += [make(c).alias(f"_a{i}_{name}") for name, make in also.items()]
    one = df.agg(*parts)
    rows = [
        F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("_n"), F.col(f"_edges{i}").alias("_edges"), *[F.col(f"_a{i}_{name}").alias(name) for name in also])
        for i, c in enumerate(cols)
    ]
    firsts = materialize(one.select(F.inline(F.array(*rows))))  # used twice
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("_v")) for c in cols])).alias("_r")).select("_r.*")
    marked = long.filter(F.col("_v").isNotNull()).join(F.broadcast(firsts.select("column", "_n", "_edges")), "column")  # a row per column
    found = _selected(marked, ["column"], probs, method).drop("n")
    return firsts.select("column", *also).join(F.broadcast(found), "column", "left")


def _brackets(value: Column, probs: dict[str, float], accuracy: int) -> list[Column]:
    """Number of values, and the edges between which each wanted rank lies."""
    margin = 3.0 / accuracy
    edges = []
    for p in probs.values():
        edges += [max(0.0, p - margin), min(1.0, p + margin)]
    return [F.count(value).alias("_n"), F.percentile_approx(value, edges, accuracy).alias("_edges")]


def _selected(marked: DataFrame, keys: list[str], probs: dict[str, float], method: str) -> DataFrame:
    """Quantiles of ``_v`` from rows that have the number of values ``_n`` and the brackets ``_edges`` of their group."""
    rank_of = METHODS[method]
    names = list(probs)
    # values inside a bracket stay as they are, those between two brackets become one counted group
    v = F.col("_v")
    inside, zone, edge = F.lit(False), F.lit(0), F.lit(False)
    for i in range(0, 2 * len(names), 2):
        low, high = F.col("_edges")[i], F.col("_edges")[i + 1]
        inside = inside | v.between(low, high)
        zone = zone + (v > low).cast("int") + (v > high).cast("int")
        edge = edge | (v == low) | (v == high)
    # a bracket is cut into cells of equal width; an edge is the largest value of its zone
    edges = [F.col("_edges")[i] for i in range(2 * len(names))]
    nearest = lambda side, pick: pick(*[F.when(side(e), e) for e in edges])
    below, above = nearest(lambda e: e < v, F.greatest), nearest(lambda e: e > v, F.least)
    cell = F.when(edge, F.lit(CELLS + 1)).otherwise(F.floor((v - below) / (above - below) * F.lit(CELLS)).cast("int"))
    place = [*keys, "_zone", "_cell"]
    counted = (
        marked.groupBy(
            *keys, "_n", F.coalesce(zone, F.lit(0)).alias("_zone"), F.when(inside, F.coalesce(cell, F.lit(0))).otherwise(-1).alias("_cell"), F.when(inside, v).alias("_exact")
        )
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    )
    # zone and cell are never null, so that both uses of the counts below are one plan and share its shuffle
    # running counts over the cells of a group, whose number is bounded, then over the values of one cell
    cells = counted.groupBy(*place).agg(F.sum("_c").alias("_in"), F.min("_lo").alias("_least"), F.max("_hi").alias("_most"))
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_zone", "_cell")
    earlier = F.sum("_in").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.select(*place, F.coalesce(earlier, F.lit(0)).alias("_before"), "_least", "_most")
    counted = counted.join(cells, place)
    w = Window.partitionBy(*place).orderBy("_exact").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("_upto", F.col("_before") + F.sum("_c").over(w))
    start = F.col("_upto") - F.col("_c")

    def at(rank: Column) -> Column:
        value = (
            F.when(F.col("_exact").isNotNull(), F.col("_exact"))
            .when(F.col("_least") == F.col("_most"), F.col("_least"))
            .when(rank == F.col("_upto"), F.col("_hi"))
            .when(rank == start + 1, F.col("_lo"))
            .otherwise(F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"))
        )
        return F.max(F.when((rank > start) & (rank <= F.col("_upto")), value))

    found, result = [], []
    for i, name in enumerate(names):
        low, high, weight = rank_of(F.col("_n"), probs[name])
        found += [at(low).alias(f"_{i}_low"), at(high).alias(f"_{i}_high"), F.max(weight).alias(f"_{i}_w")]
        step = F.col(f"_{i}_high") - F.col(f"_{i}_low")
        value = F.when(F.col(f"_{i}_w") == 0, F.col(f"_{i}_low")).otherwise(F.col(f"_{i}_low") + step * F.col(f"_{i}_w"))
        result.append(value.alias(name))
    return counted.groupBy(*keys, "_n").agg(*found).select(*keys, F.col("_n").alias("n"), *result)


def hash_order(df: DataFrame, cols: list[str], seed: int, position: str = "_rank", total: str = "_size") -> DataFrame:
    """Zero-based position of each row in the order of a seeded hash of ``cols`` (unique per row).

    The hash is the MD5 of the columns and the seed as text joined by ``|``, so the order can be had anywhere. Its
    leading digits cut the rows into a fixed number of even buckets; only the bucket counts are summed in one place.
    """
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed)))
    rows = df.withColumn("_hash", F.md5(text.cast("binary")))
    rows = rows.withColumn("_bucket", F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int"))
    counts = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_c"))
    everything = Window.partitionBy(F.lit(0)).orderBy("_bucket")  # at most BUCKETS rows
    counts = counts.select(
        "_bucket",
        F.coalesce(F.sum("_c").over(everything.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.sum("_c").over(Window.partitionBy(F.lit(0))).alias(total),
    )
    inside = Window.partitionBy("_bucket").orderBy("_hash", *cols)
    return (
        rows.join(F.broadcast(counts), "_bucket")  # bounded by BUCKETS
        .withColumn(position, F.row_number().over(inside).cast("long") - 1 + F.col("_offset"))
        .drop("_bucket", "_offset", "_hash")
    )


def sorted_offset(df: DataFrame, cols: list[str], weight: Column, out: str) -> DataFrame:
    """Sum of ``weight`` over all rows that come earlier in the order of ``cols`` (unique per row).

    Rows are range-partitioned and the partition of each row is stored, so the order is fixed once; partition sums
    are added up in one small step and rows inside a partition by a window.
    """
    ranged = df.withColumn("_weight", weight).repartitionByRange(*cols)
    stored = materialize(ranged.withColumn("_part", F.spark_partition_id()))
    sums = stored.groupBy("_part").agg(F.sum("_weight").alias("_w"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", F.sum("_w").over(before).alias("_offset"))  # one row per shuffle partition
    inside = Window.partitionBy("_part").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    return (
        stored.join(F.broadcast(sums), "_part")
        .withColumn(out, F.coalesce("_offset", F.lit(0)) + F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
        .drop("_part", "_offset", "_weight")
    )
