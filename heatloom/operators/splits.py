"""Train / validation / test splits, as a ``split`` column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatloom.functions.order import hash_order
from heatloom.functions.series import DAILY, SLICE, Series
from heatloom.functions.skew import spread_join

SPLITS = ("train", "val", "test")


def _time_cuts(n: Column, train_per: float) -> tuple[Column, Column]:
    """Last position of train and of test in a series of ``n`` rows."""
    p = float(train_per)
    return F.floor(n * F.lit(p)), F.floor(n * F.lit((1 - p) / 2 + p))


def _sizes(n: Column, train_per: float) -> tuple[Column, Column, Column]:
    first, second = _time_cuts(n, train_per)
    train = F.least(first + 1, n)
    test = F.greatest(F.least(second, n - 1) - first, F.lit(0))
    return train, test, n - train - test


def _kept_train(train: Column, remove_per: float) -> Column:
    return F.floor(train * F.lit(1 - float(remove_per))) if remove_per else train


def split_time(
    df: DataFrame,
    train_per: float = 0.8,
    s: Series = DAILY,
    remove_per: float = 0.0,
    min_len: int | None = None,
) -> DataFrame:
    """Split each series in time order: train, then test, then validation.

    Train holds the positions up to ``floor(n * train_per)`` inclusive, so it is one row longer than its share.
    ``remove_per`` drops the oldest share of train. With ``min_len`` a series is discarded if any of its parts has
    no more than that many rows.
    """
    rows = s.numbered(df)
    n, pos = F.col("_total"), F.col("_pos")
    first, second = _time_cuts(n, train_per)
    rows = rows.withColumn("split", F.when(pos <= first, "train").when(pos <= second, "test").otherwise("val"))
    train, test, val = _sizes(n, train_per)
    kept = _kept_train(train, remove_per)
    if remove_per:
        rows = rows.filter((F.col("split") != "train") | (pos >= train - kept))
    if min_len is not None:
        rows = rows.filter((kept > min_len) & (test > min_len) & (val > min_len))
    return rows.drop("_pos", "_total")


def split_discard_short(df: DataFrame, min_len: int, train_per: float = 0.8, s: Series = DAILY) -> DataFrame:
    """Time split without the series in which a part has no more than ``min_len`` rows."""
    return split_time(df, train_per, s, min_len=min_len)


def discarded_ids(df: DataFrame, min_len: int, train_per: float = 0.8, s: Series = DAILY, remove_per: float = 0.0) -> DataFrame:
    """Ids the time split discards."""
    sizes = df.groupBy(s.id).agg(F.count(F.lit(1)).alias("n"))
    train, test, val = _sizes(F.col("n"), train_per)
    short = (_kept_train(train, remove_per) <= min_len) | (test <= min_len) | (val <= min_len)
    return sizes.filter(short).select(s.id)


def train_head_removal(df: DataFrame, remove_per: float, train_per: float = 0.8, s: Series = DAILY) -> DataFrame:
    """Time split whose train part lacks its oldest ``remove_per`` share."""
    return split_time(df, train_per, s, remove_per=remove_per)


def split_date(
    df: DataFrame, date: str, min_len: int, s: Series = DAILY, remove_per: float = 0.0, train_per: float = 0.9
) -> DataFrame:
    """Rows before ``date`` become train and, from their last tenth, validation; rows after it test.

    Rows at the date itself belong to no part. A series whose train or validation part is shorter than ``min_len``
    is discarded whole; a test part of no more than ``min_len`` rows is discarded alone. ``remove_per`` keeps the
    first share of train here.
    """
    cut = F.lit(date).cast(df.schema[s.time].dataType)
    t = F.col(s.time)
    whole = Window.partitionBy(s.id)
    # position in the series and both counts from one pass
    rows = s.carry(
        df,
        {"_n": F.count(F.lit(1)), "_b": F.count(F.when(t < cut, 1)), "_a": F.count(F.when(t > cut, 1))},
        {
            "_offset": lambda w: F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "_before": lambda w: F.sum("_b").over(whole),
            "_after": lambda w: F.sum("_a").over(whole),
        },
        {"_pos": lambda w: F.row_number().over(w)},
    )
    place = F.col("_pos").cast("long") - 1 + F.coalesce("_offset", F.lit(0))
    rows = rows.withColumn("_pos", place).drop("_offset", SLICE)
    pos, before, after = F.col("_pos"), F.col("_before"), F.col("_after")
    last = F.floor(before * F.lit(float(train_per)))
    train = F.least(last + 1, before)
    kept = F.floor(train * F.lit(float(remove_per))) if remove_per else train
    val = before - train
    rows = rows.withColumn(
        "split",
        F.when((t < cut) & (pos <= last), F.when(pos < kept, "train")).when(t < cut, "val").when(t > cut, "test"),
    )
    long_enough = (before == 0) | ((kept >= min_len) & (val >= min_len))
    rows = rows.filter(F.col("split").isNotNull() & long_enough)
    return rows.filter((F.col("split") != "test") | (after > min_len)).drop("_pos", "_before", "_after")


def split_fixed_dates(df: DataFrame, val_from: str = "2021-08-01", test_from: str = "2021-11-01", time: str = "datetime") -> DataFrame:
    """Train before the first date, validation up to the second, test from there on."""
    day = F.to_date(time)
    later = F.when(day < F.lit(test_from).cast("date"), "val").otherwise("test")
    return df.withColumn("split", F.when(day < F.lit(val_from).cast("date"), "train").otherwise(later))


def scan_split_lists(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Records with ``train_ids``, ``val_ids`` and ``test_ids`` lists to rows of id and split.

    Long lists are best kept as many records, one per line; ``multi_line`` reads files that are one record each.
    """
    schema = ", ".join(f"{p}_ids array<string>" for p in SPLITS)
    raw = spark.read.option("multiLine", multi_line).schema(schema).json(path)
    named = [F.struct(F.lit(p).alias("split"), F.col(f"{p}_ids").alias("ids")) for p in SPLITS]
    lists = raw.select(F.explode(F.array(*named)).alias("_l"))
    return lists.select(F.explode("_l.ids").alias("id"), F.col("_l.split").alias("split"))


def split_id_list(df: DataFrame, lists: DataFrame, id_col: str = "id", by: str = "datetime") -> DataFrame:
    """Rows of listed ids with the split their id is listed under; an id may be in several."""
    lists = lists.select(F.col("id").alias("_id"), "split").distinct()
    rows = df.withColumn("_id", F.col(id_col).cast("string"))
    return spread_join(rows, lists, "_id", "inner", by=by).drop("_id")


def split_group(df: DataFrame, train_per: float = 0.8, seed: int = 42, s: Series = DAILY) -> DataFrame:
    """Whole series go to train, validation or test by the rank of a seeded hash of their id."""
    ids = hash_order(df.select(s.id).distinct(), [s.id], seed)
    test = F.ceil(F.col("_size") * F.lit(1 - float(train_per)))
    held = F.ceil(test / 2)
    rank = F.col("_rank")
    name = F.when(rank < F.col("_size") - test, "train").when(rank < F.col("_size") - held, "test").otherwise("val")
    return spread_join(df, ids.select(s.id, name.alias("split")), s.id, "inner", by=s.time)


def split_boundary_overlap(
    df: DataFrame, valid: int, test: int, overlap: int = 7, index: str = "days_from_start"
) -> DataFrame:
    """Cut by a day index; validation and test start ``overlap`` days early, so such rows appear twice."""
    i = F.col(index)
    names = F.array(
        F.when(i < valid, "train"),
        F.when((i >= valid - overlap) & (i < test), "val"),
        F.when(i >= test - overlap, "test"),
    )
    return df.withColumn("split", F.explode(names)).filter(F.col("split").isNotNull())


def split_year(
    df: DataFrame, valid: int = 2016, test: int = 2018, end: str = "2019-06-28", time: str = "date"
) -> DataFrame:
    """Cut by calendar year; test ends with ``end``."""
    year = F.year(time)
    rows = df.withColumn("split", F.when(year < valid, "train").when(year < test, "val").otherwise("test"))
    return rows.filter((F.col("split") != "test") | (F.to_date(time) <= F.lit(end).cast("date")))


def select_split(df: DataFrame, split: str) -> DataFrame:
    """Rows of one split."""
    if split not in SPLITS:
        raise ValueError(f"unknown split {split!r}")
    return df.filter(F.col("split") == split).drop("split")


def xy_columns(df: DataFrame, features: Sequence[str], n_out: int, target: str = "diff", s: Series = DAILY) -> DataFrame:
    """Id, time, split, feature columns without targets, and target columns.

    Rows of a series and time slice lie together in order of time; the table as a whole is not sorted.
    """
    targets = [target] + [f"{target}(t+{i})" for i in range(1, n_out)]
    inputs = sorted(set(features) - set(targets))
    names = [s.id, s.time, "split", *inputs, *targets]
    rows = s.sliced(df).repartition(s.id, SLICE).sortWithinPartitions(s.id, s.time)
    return rows.select(*[F.col(f"`{c}`") for c in names])
