"""Rows laid out by series and slice: what later steps shuffle, and runs over slice borders against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from heatloom import DAILY
from heatloom.functions.series import SLICE, Series
from heatloom.functions.tables import drop_stored, store_buckets, stored_paths
from heatloom.operators import cleaning
from heatloom.plans import cleaning as chains
from tests.data import by_series, frame, random_series, rows_of

S = Series("day", points=50)


def shuffled_records(spark, df):
    """Rows that each exchange of the plan has written, largest first."""
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        execution = df.select("*")._jdf.queryExecution()
        execution.toRdd().count()
        found, todo = [], [execution.executedPlan()]
        while todo:
            node = todo.pop()
            if node.getClass().getSimpleName() == "ShuffleExchangeExec":
                found.append(node.metrics().apply("shuffleRecordsWritten").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return sorted(found, reverse=True) or [0]
    finally:
        spark.conf.set(key, before)


def long_series(spark, ids=12, days=900):
    rnd = random.Random(4)
    rows = []
    for i in range(ids):
        total = 0.0
        for d in range(days if i else 4 * days):  # the first holds a quarter of all rows
            if rnd.random() < 0.02 and 0 < d < days - 1:
                continue
            x = rnd.choice([0.0, 0.0, 5.0, float(rnd.randint(1, 40))])
            total += x
            rows.append((f"s{i}", d, x, total))
    return frame(spark, rows)


@pytest.mark.parametrize(
    "step",
    [
        lambda df: cleaning.drop_reconnect_spikes(df, S),
        lambda df: cleaning.drop_flat_lines(df, S, 3),
        lambda df: cleaning.counter_to_diff(df, S),
        lambda df: cleaning.ffill(df, ["value"], S),
        lambda df: cleaning.split_at_gaps(df, S, 2),
        lambda df: cleaning.iqr_filter(df, S),
        lambda df: cleaning.drop_positive_jumps(df, S, 30),
        lambda df: S.numbered(df),
        lambda df: cleaning.drop_flat_lines(cleaning.iqr_filter(cleaning.drop_reconnect_spikes(df, S), S), S, 3),
    ],
    ids=["reconnect", "flat", "diff", "ffill", "split", "iqr", "jumps", "numbered", "chain"],
)
def test_steps_shuffle_seams_only(shuffled, step):
    """No exchange writes more than a tenth of the rows, with no side small enough to be broadcast; the rows are those of the plain frame."""
    df = long_series(shuffled)
    laid = S.laid_out(df)
    n = df.count()
    assert n > 10_000 and SLICE in laid.columns
    out = step(laid)
    assert shuffled_records(shuffled, out)[0] < n / 10
    assert shuffled_records(shuffled, step(df))[0] > n / 2
    assert rows_of(out.drop(SLICE)) == rows_of(step(df).select(*out.drop(SLICE).columns))


def test_chains_keep_one_table(spark):
    df = random_series(spark, ids=10, days=50)
    before = stored_paths()
    chains.clean_basic(df, DAILY, 4).collect()
    assert len(stored_paths()) - len(before) == 1
    before = stored_paths()
    chains.clean_interpolated(df.filter("diff IS NOT NULL AND value IS NOT NULL"), DAILY, 4, 7).collect()
    assert len(stored_paths()) - len(before) == 1  # each goes when the next is there


def test_buckets_are_dropped(spark):
    df = store_buckets(random_series(spark, ids=3), ["id"], ["id", "datetime"], 3)
    n = df.count()
    (path,) = stored_paths()[-1:]
    name = f"stored_{path.rsplit('/', 1)[-1]}"
    assert n and spark.catalog.tableExists(name)
    drop_stored(spark, [path])
    assert not spark.catalog.tableExists(name)


@pytest.mark.parametrize("points", [1, 3, 7, 8192])
def test_runs(spark, points):
    """Lengths of runs at every kind of border, against a loop over each series."""
    s = Series("day", points=points)
    df = random_series(spark, ids=30, days=40, hot=300, null=0.2)
    got = s.runs(df, F.col("diff") != 0, F.col("diff"), also={"_end": (F.max("datetime"), F.max)})
    assert SLICE not in got.columns
    found = {(r["id"], r["datetime"]): (r["_length"], r["_leading"], r["_end"]) for r in got.collect()}
    for name, rows in by_series(df).items():
        runs = [[]]
        for r in rows:
            if r["diff"]:
                runs.append([])
            runs[-1].append(r)
        for k, run in enumerate(runs):
            length = sum(r["diff"] is not None for r in run)
            for r in run:
                assert found.pop((name, r["datetime"])) == (length, k == 0, rows[-1]["datetime"])
    assert not found
