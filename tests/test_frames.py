"""Windows, joins, sources and metrics on hand-written rows."""

import json

import pytest
from pyspark.sql import functions as F

from heatloom import Series
from heatloom.operators import forecast, frames, joins, metrics, profile, rows
from heatloom.schema import Role
from heatloom.sources import readers, writers
from tests.data import at, day_of, frame, random_series, by_series, rows_of, series

S = Series("day", points=3, chunk=4)
ROLES = [Role("id", "categorical", "id"), Role("datetime", "date", "time"), Role("diff", "real", "target"), Role("value", "real", "observed")]


@pytest.mark.parametrize("lag_in,lag_out", [(0, 1), (2, 3), (6, 2)])
def test_supervised_frame_against_brute_force(spark, lag_in, lag_out):
    df = random_series(spark, ids=12, days=20, hot=150, seed=9).cache()
    want = []
    for i, rs in by_series(df).items():
        for k in range(lag_in, len(rs) - lag_out + 1):
            window = rs[k - lag_in : k + lag_out]
            if all(r.diff is not None and r.value is not None for r in window):
                want.append((i, rs[k].datetime, tuple((r.diff, r.value) for r in window)))
    out = frames.supervised_frame(df, ["diff", "value"], lag_in, lag_out, S)
    got = [(r["id"], r["datetime"], tuple((x.diff, x.value) for x in r["steps"])) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_null_inside_window_drops_only_its_windows(spark):
    df = series(spark, a=[(0, 1), (1, None), (2, 3), (3, 4), (4, 5)])
    out = frames.supervised_frame(df, ["diff"], 1, 1, S)
    assert [r["day"] for r in out.select(day_of()).orderBy("day").collect()] == [3, 4]
    kept = frames.supervised_frame(df, ["diff"], 1, 1, S, dropnan=False)
    assert kept.count() == 4


def test_short_series_give_no_windows(spark):
    df = series(spark, a=[(d, d) for d in range(4)], b=[(d, d) for d in range(5)])
    out = frames.sliding_windows(df, ROLES, 5, 3, s=S).collect()
    assert [(r["id"], r["outputs"], r["active_entries"]) for r in out] == [("b", [3.0, 4.0], [1.0, 1.0])]
    assert out[0]["inputs"][1] == [1.0, 10.0] and out[0]["identifier"] == ["b"] * 5


def test_sampled_windows_subset(spark):
    df = series(spark, a=[(d, d) for d in range(40)], b=[(d, d) for d in range(9)])
    every = rows_of(frames.sliding_windows(df, ROLES, 5, 3, s=S), "id", "window_start")
    some = rows_of(frames.sampled_windows(df, ROLES, 5, 3, 10, s=S), "id", "window_start")
    assert len(some) == len(set(some)) == 10 and set(some) <= set(every)
    assert some == rows_of(frames.sampled_windows(df.repartition(7), ROLES, 5, 3, 10, s=S), "id", "window_start")
    with pytest.raises(ValueError):
        frames.sampled_windows(df, ROLES, 5, 3, 0, s=S)


def test_lag_needs_one(spark):
    with pytest.raises(ValueError):
        frames.lag_any_column(series(spark, a=[(0, 1)]), "diff", 0)


def test_base_id_variants(spark):
    df = spark.createDataFrame([("a",), ("a-1",), ("a-1-2",), ("a-1-2-3",), ("12",), ("1",)], "id string")
    out = rows.base_id(rows.base_id(df, "two", out="two"), "all", out="every")
    got = {r["id"]: (r["two"], r["every"]) for r in out.collect()}
    assert got == {"a": ("a", "a"), "a-1": ("a", "a"), "a-1-2": ("a", "a"), "a-1-2-3": ("a-1", "a"), "12": ("12", "12"), "1": ("1", "1")}


def test_season_boundaries(spark):
    days = ["03-20", "03-21", "06-20", "06-21", "09-22", "09-23", "12-20", "12-21", "01-01"]
    df = spark.createDataFrame([(f"2024-{d}",) for d in days], "t string").select(F.to_date("t").alias("datetime"))
    got = [r["season"] for r in rows.season(df).collect()]
    assert got == ["Winter", "Spring", "Spring", "Summer", "Summer", "Fall", "Fall", "Winter", "Winter"]


def test_errors_are_raised(spark):
    df = spark.createDataFrame([("x", 1000)], "c string, n int")
    with pytest.raises(Exception, match="no entry"):
        rows.static_map(df, "c", {"y": "z"}, "out").collect()
    with pytest.raises(Exception, match="digits"):
        rows.composite_key(df, ["n"], [3]).collect()
    with pytest.raises(ValueError):
        rows.require_features(df, ["absent"])


def holidays(spark):
    data = [("X", "2024-01-02", "2024-01-04", "i"), ("X", "2024-01-10", None, "d"), ("Y", "2024-01-20", None, "d")]
    df = spark.createDataFrame(data, "state string, start string, end string, type string")
    return df.withColumns({"start": F.to_date("start"), "end": F.to_date("end")})


def test_holiday_modes(spark):
    times = [("X", at(1)), ("X", at(1, 5)), ("X", at(3, 23)), ("X", at(4)), ("X", at(9)), ("Y", at(9)), ("Z", at(1))]
    df = spark.createDataFrame([(s, t, str(k)) for k, (s, t) in enumerate(times)], "state string, datetime timestamp_ntz, id string")
    flags = lambda mode: [r["holiday"] for r in joins.holiday_flag(df, holidays(spark), mode).orderBy(F.col("id")).collect()]
    assert flags("calendar") == [1, 1, 1, 0, 1, 0, 0]
    assert flags("midnight") == [1, 0, 0, 0, 0, 0, 0]
    with pytest.raises(ValueError):
        joins.holiday_flag(df, holidays(spark), "noon")


def test_subtract_meter_needs_equal_length(spark):
    schema = "new_id string, Title string, date date, diff double"
    df = spark.createDataFrame([("a", "t", at(0).date(), 5.0), ("b", "t", at(0).date(), 2.0), ("c", "t", at(0).date(), 1.0), ("c", "t", at(1).date(), 1.0)], schema)
    assert rows_of(joins.subtract_meter(df, "a", "b").filter("new_id = 'a'"), "Title", "diff") == [("Gaszähler", 3.0)]
    with pytest.raises(Exception, match="differ in length"):
        joins.subtract_meter(df, "a", "c").collect()


def test_several_holidays_on_one_day_keep_row_count(spark):
    ev = spark.createDataFrame(
        [(at(0), "National", "E", "b", False), (at(0), "National", "E", "a", False), (at(0), "Local", "C1", "c", True)],
        "date timestamp_ntz, locale string, locale_name string, description string, transferred boolean",
    )
    df = spark.createDataFrame([(at(0), "S1", "C1", 1), (at(1), "S1", "C1", 2)], "date timestamp_ntz, state string, city string, item_nbr int")
    out = joins.scoped_holidays(df, ev).orderBy("item_nbr").collect()
    assert [(r["national_hol"], r["regional_hol"], r["local_hol"]) for r in out] == [("a", "", ""), ("", "", "")]


def test_coverage_of_complete_series_is_below_100(spark):
    out = profile.missing_points(series(spark, a=[(d, 1) for d in range(9)], b=[(0, 1), (4, 1)]), S)
    assert rows_of(out, "id", "len", "n", "per") == [("a", 0, 9, 90.0), ("b", 3, 2, round(100 * 2 / 6, 9))]
    spans = profile.gap_spans(series(spark, b=[(0, 1), (4, 1), (5, 1), (7, 1)]), S)
    assert rows_of(spans, "id", "start", "end", "n") == [("b", at(1), at(3), 3), ("b", at(6), at(6), 1)]


def test_histogram_of_one_value(spark):
    out = profile.histogram(spark.createDataFrame([(2.0,), (2.0,)], "diff double"), "diff", 4)
    assert rows_of(out, "bin", "count") == [(0, 2), (1, 0), (2, 0), (3, 0)]


def test_readers(spark, tmp_path):
    path = str(tmp_path / "r.csv")
    open(path, "w").write("extra,value,id,diff,datetime\n1,2.5,a,,2024-01-01 00:00:00\n")
    got = readers.scan_readings(spark, path, "x").select("id", F.col("datetime").cast("timestamp_ntz").alias("t"), "diff", "value", "source")
    assert rows_of(got) == [("a", at(0), None, 2.5, "x")]
    lines = str(tmp_path / "lines.txt")
    open(lines, "w").write("[1 2;3 4]\n[5 6;7 8]\n")
    cells = readers.parse_matrix_lines(readers.scan_lines(spark, lines))
    assert rows_of(cells, "line_no", "row", "slot", "value") == [(n, r, c, float(4 * n + 2 * r + c + 1)) for n in (0, 1) for r in (0, 1) for c in (0, 1)]
    out = writers.write_dataset(got, str(tmp_path / writers.dataset_name("daily", True)), ["source"])
    assert rows_of(out) == rows_of(got)
    assert writers.dataset_name("hourly", features=True) == "dataset_hourly_feat"
    lists = str(tmp_path / "lists.json")
    open(lists, "w").write(json.dumps({"train_ids": ["a"], "val_ids": ["b", "c"], "test_ids": []}, indent=1))
    from heatloom.operators.splits import scan_split_lists

    assert rows_of(scan_split_lists(spark, lists, multi_line=True)) == [("a", "train"), ("b", "val"), ("c", "val")]


def preds(spark, data):
    return spark.createDataFrame([(i, at(d), h, float(y), float(p)) for i, d, h, y, p in data], "id string, datetime timestamp_ntz, h bigint, y double, y_hat double")


def test_metrics(spark):
    pred = preds(spark, [("a", 0, 0, 0, 1), ("a", 0, 1, 4, 2), ("a", 1, 0, 2, 2), ("a", 1, 1, 2, 2)])
    core = {r["h"]: r for r in metrics.metrics_core(pred).collect()}
    assert core[0]["mse"] == 0.5 and core[0]["mae"] == 0.5 and core[1]["rmse"] == pytest.approx(2**0.5)
    assert core[1]["nrmse"] == pytest.approx(2**0.5 / 2)  # the mean target of both horizons is 2
    assert core[0]["mape"] == pytest.approx(50 / 2.220446049250313e-16) and core[1]["mape"] == 25
    assert rows_of(metrics.row_rse(pred), "rse") == [(0.0,), (round(2.5**0.5, 9),)]
    with pytest.raises(ValueError):
        metrics.pinball_loss(pred, [1.5])
    with pytest.raises(Exception, match="mean prediction is zero"):
        metrics.normalize_by_group_mean(preds(spark, [("a", 0, 0, 1, 0)])).collect()


def test_seasonal_naive_leaves_out_zero_predictions(spark):
    df = series(spark, a=[(0, 1), (1, 0), (2, 3), (3, 4)])
    out = forecast.seasonal_naive(df, 1, S)
    assert rows_of(out, "datetime", "y", "y_hat") == [(at(1), 0.0, 1.0), (at(3), 4.0, 3.0)]


def test_clusters_separate_levels(spark):
    df = frame(spark, [(f"s{k}", d, 10 ** (k % 3) + d % 2, 0) for k in range(12) for d in range(20)])
    labels = {r["id"]: r["label"] for r in forecast.cluster_buildings(df, 3, s=S).collect()}
    assert labels == {f"s{k}": k % 3 for k in range(12)}


def test_tree_fits_steps(spark):
    df = frame(spark, [("a", d, float(d % 4 > 1), d % 4) for d in range(60)]).drop("source")
    models = forecast.tree_forecast(df, ["value"], 1, depth=3)
    out = forecast.predict_long(df, models, ["value"], s=S)
    assert out.filter("abs(y - y_hat) > 1e-9").count() == 0
