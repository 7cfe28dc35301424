"""Edges of the cleaning steps, and all of them against brute force with one dominant series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatloom import Series
from heatloom.operators import cleaning, rows
from heatloom.plans.cleaning import clean_basic, clean_interpolated
from tests.data import at, by_series, day_of, frame, random_series, rows_of, series

S = Series("day", points=3, chunk=4)


def days(df, *cols):
    return [tuple(r) for r in df.select("id", day_of(), *cols).orderBy("id", "day").collect()]


def test_drop_negative_drops_null(spark):
    df = series(spark, a=[(0, 1), (1, -1), (2, None), (3, 0)])
    assert days(rows.drop_negative(df)) == [("a", 0), ("a", 3)]


def test_flat_lines_zero_head(spark):
    # three zeros at the start count as two; the run of four after the value is one more than allowed
    df = series(spark, a=[(0, 0), (1, 0), (2, 0), (3, 5), (4, 0), (5, 0), (6, 0), (7, 0), (8, 2), (9, 0)])
    assert [d for _, d in days(cleaning.drop_flat_lines(df, S, 3))] == [0, 1, 2, 3, 8, 9]
    assert [d for _, d in days(cleaning.drop_flat_lines(df, S, 1))] == [0, 3, 8, 9]
    assert [d for _, d in days(cleaning.drop_flat_lines(df, S, 4))] == list(range(10))


def test_flat_lines_keep_null_rows(spark):
    df = series(spark, a=[(0, None), (1, 0), (2, 0), (3, 0), (4, None), (5, 0)])
    assert [d for _, d in days(cleaning.drop_flat_lines(df, S, 1))] == [0, 1, 4]


def test_reconnect_daily_and_hourly(spark):
    df = series(spark, a=[(0, 1), (1, 1), (3, 9), (4, 1)])
    assert [d for _, d in days(cleaning.drop_reconnect_spikes(df, S))] == [0, 1, 4]
    hours = [0, 1, 4, 5, 9, 10]  # two missing, then three missing
    df = spark.createDataFrame([("a", at(0, h), 1.0) for h in hours], "id string, datetime timestamp_ntz, diff double")
    kept = cleaning.drop_reconnect_spikes(df, Series("hour", points=2)).select(F.hour("datetime").alias("h")).collect()
    assert sorted(r["h"] for r in kept) == [0, 1, 4, 5, 10]


def test_series_without_gaps_is_unchanged(spark):
    df = series(spark, a=[(d, 1) for d in range(9)])
    assert rows_of(cleaning.drop_reconnect_spikes(df, S)) == rows_of(df)


def test_positive_jumps_median_zero_deletes_series(spark):
    df = series(spark, a=[(0, 0), (1, 0), (2, 0), (3, 5)], b=[(0, 1), (1, 2), (2, 100)])
    assert days(cleaning.drop_positive_jumps(df, S)) == [("b", 0), ("b", 1)]


def test_leading_zeros(spark):
    df = frame(spark, [("a", 0, 0, 0), ("a", 1, 7, 7), ("a", 2, 0, 7), ("a", 3, 2, 9), ("b", 0, 0, 1)])
    assert days(cleaning.drop_leading_zeros(df, S)) == [("a", 2), ("a", 3)]


@pytest.mark.parametrize("gap", [1, 2, 3])
def test_split_gap_edges(spark, gap):
    # gaps of gap-1, gap and gap+1 grid points between blocks of five days
    points, d = [], 0
    for missing in (gap - 1, gap, gap + 1, 0):
        points += [(d + k, 1) for k in range(5)]
        d += 5 + missing
    out = cleaning.split_at_gaps(series(spark, a=points), S, gap)
    counts = {r["id"]: r["count"] for r in out.groupBy("id").count().collect()}
    assert counts == {"a-0": 10, "a-1": 5, "a-2": 5}


def test_split_numbers_parts_before_dropping_short_ones(spark):
    df = series(spark, a=[(0, 1), (5, 1), (6, 1), (7, 1), (12, 1)], b=[(0, 1), (1, 1)], c=[(0, 1)])
    out = cleaning.split_at_gaps(df, S, 2)
    assert sorted({r["id"] for r in out.collect()}) == ["a-1", "b", "c"]
    assert cleaning.split_at_gaps(series(spark, a=[(0, 1), (9, 1)]), S, 3).count() == 0


def test_interpolation_edges(spark):
    df = frame(spark, [("a", 0, 4, 10), ("a", 3, 9, 40), ("a", 4, None, None), ("a", 5, 1, 60)])
    got = [tuple(r)[1:] for r in cleaning.interpolate_linear(df, S).select("id", day_of(), "value", "diff").orderBy("day").collect()]
    assert got == [(0, 10.0, 4.0), (1, 20.0, 10.0), (2, 30.0, 10.0), (3, 40.0, 10.0), (4, 50.0, 10.0), (5, 60.0, 10.0)]
    ends = frame(spark, [("a", 0, 3, None), ("a", 1, 2, 5), ("a", 3, 2, None)])
    got = [tuple(r) for r in cleaning.interpolate_linear(ends, S).select(day_of(), "value", "diff").orderBy("day").collect()]
    assert got == [(0, 5.0, 3.0), (1, 5.0, 0.0), (2, 5.0, 0.0), (3, 5.0, 0.0)]


def test_resample_log_of_zero(spark):
    df = spark.createDataFrame([("a", at(0), 0.0, "x"), ("a", at(2), 1.0, None)], "traj_id string, date timestamp_ntz, unit_sales double, k string")
    out = cleaning.resample_last(df, ["k"]).orderBy("date").collect()
    assert [(r["open"], r["k"], r["log_sales"]) for r in out] == [(1, "x", float("-inf")), (0, "x", None), (1, "x", 0.0)]


@pytest.fixture(scope="module")
def hot(spark):
    """About half of all rows are in one series."""
    return random_series(spark, ids=30, days=40, hot=500, seed=5).cache()


def test_against_brute_force(hot, shuffled):
    data = by_series(hot)
    values = {i: [r.diff for r in rs if r.diff is not None] for i, rs in data.items()}

    want = []
    for i, rs in data.items():
        ordered = sorted(values[i])
        if not ordered:
            continue
        pick = lambda q, o=ordered: o[int((len(o) - 1) * q + 0.5)]
        upper = pick(0.75) + 1.5 * (pick(0.75) - pick(0.25))
        want += [(i, r.datetime) for r in rs if r.diff is not None and r.diff <= upper]
    assert rows_of(cleaning.iqr_filter(hot, S), "id", "datetime") == sorted(want, key=repr)

    want = [(i, r.datetime) for i, rs in data.items() for r in rs if r.diff is not None and r.diff < 3 * np.median(values[i])]
    assert rows_of(cleaning.drop_positive_jumps(hot, S, 3), "id", "datetime") == sorted(want, key=repr)

    want = []
    for i, rs in data.items():
        runs, run = {}, 0
        for r in rs:
            if r.diff is not None:
                run += r.diff != 0
                runs.setdefault(run, []).append(r)
        want += [(i, r.datetime) for r in rs if r.diff is None]
        want += [(i, r.datetime) for g in runs.values() for k, r in enumerate(g) if k == 0 or len(g) - 1 <= 2]
    assert rows_of(cleaning.drop_flat_lines(hot, S, 2), "id", "datetime") == sorted(want, key=repr)

    want = []
    for i, rs in data.items():
        last = None
        for r in rs:
            last = r.diff if r.diff is not None else last
            want.append((i, r.datetime, last))
    assert rows_of(cleaning.ffill(hot, ["diff"], S), "id", "datetime", "diff") == sorted(want, key=repr)


def test_split_against_brute_force(hot, shuffled):
    want = []
    for i, rs in by_series(hot.dropna(how="all", subset=["value", "diff"])).items():
        parts = [[rs[0]]]
        for a, b in zip(rs, rs[1:]):
            if (b.datetime - a.datetime).days - 1 >= 2:
                parts.append([])
            parts[-1].append(b)
        for k, part in enumerate(parts):
            if len(parts) == 1:
                want += [(i, r.datetime) for r in part]
            elif (part[-1].datetime - part[0].datetime).days + 1 > 2:
                want += [(f"{i}-{k}", r.datetime) for r in part]
    assert rows_of(cleaning.split_at_gaps(hot, S, 2), "id", "datetime") == sorted(want, key=repr)


def test_interpolation_against_pandas(hot, shuffled):
    import pandas as pd

    got = cleaning.interpolate_linear(hot, S)
    want = []
    for i, rs in by_series(hot).items():
        s = pd.Series([r.value for r in rs], index=pd.to_datetime([r.datetime for r in rs]), dtype="float64").asfreq("D")
        filled = s.interpolate("linear", limit_direction="both")
        diff = filled.diff()
        for k, t in enumerate(filled.index):
            v = filled.iloc[k]
            if k == 0:
                d = rs[0].diff
            else:
                d = None if np.isnan(v) else diff.iloc[k]
            want.append((i, t.to_pydatetime(), None if np.isnan(v) else v, d))
    got = {(r["id"], r["datetime"]): (r["value"], r["diff"]) for r in got.collect()}
    assert set(got) == {(w[0], w[1]) for w in want}
    for i, t, v, d in want:
        assert got[i, t][0] == pytest.approx(v, abs=1e-6) if v is not None else got[i, t][0] is None
        assert got[i, t][1] == pytest.approx(d, abs=1e-6) if d is not None else got[i, t][1] is None


def test_chain_invariants(hot):
    basic = clean_basic(hot, S, 3)
    assert basic.filter("diff < 0 or diff is null").count() == 0
    full = clean_interpolated(hot.dropna(), S, 3, 4)
    assert full.filter("diff < 0").count() == 0
    # every part is a dense grid
    spans = full.groupBy("id").agg(F.count("*").alias("n"), (F.datediff(F.max("datetime"), F.min("datetime")) + 1).alias("grid"))
    assert spans.filter("n <> grid").count() == 0


def test_gap_of_fifty_years_in_hours(spark):
    """A wrong time stamp makes many rows, but no long array."""
    from heatloom.functions.series import HOURLY
    from heatloom.operators import cleaning

    df = spark.sql("SELECT 'a' id, t AS datetime, 1.0D AS diff, v AS value, 's' AS source FROM VALUES (timestamp'1970-01-01', 0.0D), (timestamp'2020-01-01', 438288.0D) x(t, v)")
    n = 438288 + 1
    assert cleaning.fill_grid(df, HOURLY).distinct().count() == n
    filled = cleaning.interpolate_linear(df, HOURLY)
    assert filled.count() == n and filled.selectExpr("max(abs(value - (unix_timestamp(datetime) div 3600)))").first()[0] < 1e-6


def test_chain_keeps_one_stored_table(spark):
    from heatloom.functions.series import Series
    from heatloom.functions.tables import stored_paths
    from heatloom.plans.cleaning import clean_interpolated

    df = spark.sql("SELECT concat('b', i % 3) id, date_add(date'2024-01-01', cast(i div 3 as int)) + interval 0 hour AS datetime, 1.0D + i % 5 AS diff, cast(i as double) AS value, 's' AS source FROM range(300) r(i)")
    before = stored_paths()
    clean_interpolated(df, Series("day"), 4, 7).count()
    assert len(stored_paths()) == len(before) + 1
