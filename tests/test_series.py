"""Work across slice borders against brute force, with slices of a few rows and one series far longer than others."""

import pytest
from pyspark.sql import functions as F

from heatloom import Series
from heatloom.operators.profile import missing_points
from tests.data import by_series, random_series, rows_of, series

CASES = [Series("day", points=1, chunk=1), Series("day", points=4, chunk=3), Series("day", points=8192, chunk=8192)]


@pytest.fixture(scope="module", params=[0, 500], ids=["even", "hot"])
def df(spark, request):
    return random_series(spark, hot=request.param).cache()


@pytest.mark.parametrize("s", CASES, ids=["1", "4", "whole"])
def test_adjacent(df, s):
    out = s.adjacent(df, ["diff"], "_prev", "_next").select(
        "id", "datetime", F.col("_prev.datetime").alias("p"), F.col("_prev.diff").alias("pd"), F.col("_next.datetime").alias("n"), F.col("_next.diff").alias("nd")
    )
    want = []
    for i, rows in by_series(df).items():
        for k, r in enumerate(rows):
            p, n = (rows[k - 1] if k else None), (rows[k + 1] if k + 1 < len(rows) else None)
            want.append((i, r.datetime, p and p.datetime, p and p.diff, n and n.datetime, n and n.diff))
    assert rows_of(out) == sorted(want, key=repr)


@pytest.mark.parametrize("s", CASES, ids=["1", "4", "whole"])
def test_numbered_and_running_sum(df, s):
    out = s.running_sum(s.numbered(df), "diff", "total").select("id", "datetime", "_pos", "_total", "total")
    want = []
    for i, rows in by_series(df).items():
        total = 0.0
        for k, r in enumerate(rows):
            total += r.diff or 0.0
            want.append((i, r.datetime, k, len(rows), round(total, 9) + 0.0))
    assert rows_of(out) == sorted(want, key=repr)


@pytest.mark.parametrize("s", CASES, ids=["1", "4", "whole"])
def test_known(df, s):
    out = s.known(df, F.col("diff"), "_a", "_b").select(
        "id", "datetime", F.col("_a.time").alias("at"), F.col("_a.value").alias("av"), F.col("_b.time").alias("bt"), F.col("_b.value").alias("bv")
    )
    want = []
    for i, rows in by_series(df).items():
        for k, r in enumerate(rows):
            a = next((x for x in reversed(rows[:k]) if x.diff is not None), None)
            b = next((x for x in rows[k + 1 :] if x.diff is not None), None)
            want.append((i, r.datetime, a and a.datetime, a and a.diff, b and b.datetime, b and b.diff))
    assert rows_of(out) == sorted(want, key=repr)


@pytest.mark.parametrize("s", CASES, ids=["1", "4", "whole"])
def test_neighbours(df, s):
    out = s.neighbours(
        df.select("id", "datetime", "diff"), 3, 2, lambda w: {"back": F.lag("datetime", 3).over(w), "on": F.lead("datetime", 2).over(w)}
    )
    want = []
    for i, rows in by_series(df).items():
        for k, r in enumerate(rows):
            on = rows[k + 2].datetime if k + 2 < len(rows) else None
            want.append((i, r.datetime, r.diff, rows[k - 3].datetime if k >= 3 else None, on))
    assert rows_of(out) == sorted(want, key=repr)


def test_unknown_step():
    with pytest.raises(ValueError):
        Series("fortnight")


@pytest.mark.parametrize("step", ["adjacent", "numbered", "neighbours"])
def test_repeated_rows_are_an_error(spark, step):
    S = CASES[1]
    df = series(spark, a=[(0, 1), (1, 2), (1, 3), (2, 4)], b=[(0, 1)])
    run = {
        "adjacent": lambda: S.adjacent(df, ["diff"]),
        "numbered": lambda: S.numbered(df),
        "neighbours": lambda: S.neighbours(df, 1, 0, lambda w: {"p": F.lag("diff").over(w)}),
    }[step]
    with pytest.raises(Exception, match="two rows at 2024-01-02.* in series a"):
        run().collect()
    with pytest.raises(Exception, match="more readings than grid points in a"):
        missing_points(series(spark, a=[(0, 1), (1, 2), (1, 3)])).collect()


def test_other_time_zones_are_an_error(spark):
    S = CASES[1]
    key = "spark.sql.session.timeZone"
    spark.conf.set(key, "Europe/Berlin")
    try:
        with pytest.raises(ValueError, match="UTC.*Europe/Berlin"):
            S.numbered(series(spark, a=[(0, 1)]))
    finally:
        spark.conf.set(key, "UTC")
