import calendar as months
import math
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest

from tests.grids import TIMES, by_key, frame, values
from tidegrid.frame import clean, nearest
from tidegrid.operators.align import align_outer
from tidegrid.operators.climatology import climatology
from tidegrid.operators.extract import extract_bottom, extract_layer, extract_surface, nearest_time, water_mask
from tidegrid.operators.extremes import extract_annual_extremes, extract_annual_extremes_per_layer
from tidegrid.operators.plotdata import map_at, timeseries
from tidegrid.operators.stats import calculate_stats


def test_nan_and_fill_values_become_null(spark):
    t = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 1e20), (4, float("inf")), (5, None), (6, -1e20)], "k int, v double")
    assert {r["k"]: r["v"] for r in clean(t, ["v"]).collect()} == {1: 1.0, 2: None, 3: None, 4: None, 5: None, 6: None}


def test_stats_propagate_missing_values(spark):
    times = [datetime(2025, 1, d) for d in range(1, 7)]
    data = values(times, seed=3)
    data[0, 2, 1, 1, 1] = np.nan  # one step of one cell
    out = calculate_stats(frame(spark, data, times), ["all"]).table()
    rows = {(r["depth_idx"], r["lat_idx"], r["lon_idx"]): r for r in out.collect()}
    assert rows[1, 1, 1]["thetao_mean"] is None and rows[1, 1, 1]["so_mean"] is not None
    for (d, y, x), r in rows.items():
        own = data[0][:, d, y, x]
        if np.isnan(own).any():
            continue
        assert math.isclose(r["thetao_mean"], own.mean()) and math.isclose(r["thetao_variance"], own.var())
        assert math.isclose(r["thetao_median"], np.median(own)) and r["thetao_minimum"] == own.min() and r["thetao_maximum"] == own.max()
        for p in (5, 25, 75, 95):
            assert math.isclose(r[f"thetao_quartiles_{p}"], np.percentile(own, p))
    for bad in (["all", "mean"], ["mean", "mean"], ["mode"]):
        with pytest.raises(ValueError):
            calculate_stats(frame(spark), bad)


def test_extremes_golden(spark):
    times = [datetime(2024 + m // 12, m % 12 + 1, 1) for m in range(24)]
    t, d = np.arange(24)[:, None, None, None], np.arange(3)[None, :, None, None]
    data = np.stack([np.broadcast_to(t + d, (24, 3, 4, 5)), np.broadcast_to(10 - t - 2 * d, (24, 3, 4, 5))]).astype(float)
    f = frame(spark, data, times)
    got = {r["time"].year: r for r in extract_annual_extremes(f).table().collect()}
    assert (got[2024]["thetao_min"], got[2024]["thetao_max"], got[2025]["thetao_min"], got[2025]["thetao_max"]) == (0, 13, 12, 25)
    assert (got[2024]["so_min"], got[2024]["so_max"]) == (10 - 11 - 4, 10)
    assert got[2024]["time"] == datetime(2024, 1, 1)
    layers = {(r["time"].year, r["depth_idx"]): r for r in extract_annual_extremes_per_layer(f).table().collect()}
    assert layers[2025, 2]["thetao_min"] == 14 and layers[2024, 1]["so_max"] == 8
    with pytest.raises(ValueError):
        extract_annual_extremes(replace(f, tables=(f.table().drop("time"),)))


def test_extracts(spark):
    data = values()
    f = frame(spark, data, flat=True)
    surface = by_key(extract_surface(f).table_of("thetao"), ["time", "lat_idx", "lon_idx"], "thetao")
    assert len(surface) == (~np.isnan(data[0][:, 0])).sum()
    bottom = by_key(extract_bottom(f.select(["thetao"])).table(), ["time", "lat_idx", "lon_idx"], "thetao")
    for (t, y, x), v in bottom.items():
        column = data[0][TIMES.index(t), :, y, x]
        assert v == column[(~np.isnan(column)).sum() - 1]
    assert extract_bottom(f).table_of("mlotst").count() == f.table_of("mlotst").count()
    layer = extract_layer(f, 3.5).table_of("so")  # half-way between 2 and 5
    assert by_key(layer, ["time", "lat_idx", "lon_idx"], "so").keys() == by_key(f.table_of("so").where("depth_idx = 2"), ["time", "lat_idx", "lon_idx"], "so").keys()
    assert nearest([1.0, 2.0], 1.5) == 1 and nearest([1.0, 2.0], 1.4) == 0
    assert {r["time"] for r in nearest_time(f, datetime(2025, 1, 1, 12)).table_of("so").collect()} == {TIMES[1]}
    assert water_mask(f).count() == (~np.isnan(data[0][0])).sum()


def test_align_keeps_all_cells(spark):
    f = frame(spark)
    a, b = f.select(["thetao"]).table().where("lon_idx < 3"), f.select(["so"]).table().where("lon_idx > 1")
    out = align_outer([a, b])
    assert out.count() == f.table().count()
    assert out.where("latitude is null or depth is null").count() == 0
    assert out.where("thetao is null").count() == f.table().where("lon_idx > 2").count()
    with pytest.raises(ValueError):
        align_outer([a, b.drop("depth_idx", "depth")])


def _single(spark, times, x, title):
    """One cell of one variable without depth."""
    rows = [(t, 0, 42.0, 0, 30.0, v) for t, v in zip(times, x)]
    t = spark.createDataFrame(rows, "time timestamp_ntz, lat_idx int, latitude double, lon_idx int, longitude double, chl double")
    f = frame(spark, title=title)
    return replace(f, tables=(t,), axes={"latitude": [42.0], "longitude": [30.0]}, times=spark.createDataFrame([(t,) for t in times], "time timestamp_ntz"))


def test_monthly_climatology_counts_missing_months(spark):
    times = [datetime(2023 + m // 12, m % 12 + 1, 1) for m in range(24)]
    x = [float(m) for m in range(24)]
    x[1] = None  # February 2023 is missing; 2024 has 29 days
    x[2] = x[14] = None  # both Marches
    got = by_key(climatology(_single(spark, times, x, "Monthly means"), "chl", "monthly").table(), ["month"], "chl")
    assert math.isclose(got[(1,)], (0 + 12) / 2) and math.isclose(got[(2,)], 13 * 29 / 57) and got[(3,)] == 0.0
    seasons = by_key(climatology(_single(spark, times, x, "monthly"), "chl", "seasonal").table(), ["season"], "chl")
    assert math.isclose(seasons[("DJF",)], np.mean([0, 11, 12, 13, 23])) and len(seasons) == 4
    for bad in ("daily", "weekly"):
        with pytest.raises(ValueError):
            climatology(_single(spark, times, x, "monthly"), "chl", bad)
    with pytest.raises(ValueError):
        climatology(_single(spark, times, x, "yearly"), "chl", "monthly")
    with pytest.raises(ValueError):
        climatology(_single(spark, times, x, "monthly"), "no3", "monthly")


def test_daily_climatology_takes_means_of_days(spark):
    times = [datetime(2023, 1, 1) + timedelta(days=i) for i in range(731)]
    gen = np.random.default_rng(5)
    x = gen.normal(size=731)
    f = _single(spark, times, [float(v) for v in x], "daily means")
    by_doy = {}
    first = {}
    for t, v in zip(times, x):
        doy = t.timetuple().tm_yday
        by_doy.setdefault(doy, []).append(v)
        first.setdefault(doy, t.month)
    daily = {r["doy"]: r for r in climatology(f, "chl", "daily").table().collect()}
    assert len(daily) == 366 and all(math.isclose(daily[d]["chl"], np.mean(v)) and daily[d]["month"] == first[d] for d, v in by_doy.items())
    monthly = by_key(climatology(f, "chl", "monthly").table(), ["month"], "chl")
    for m in range(1, 13):
        assert math.isclose(monthly[(m,)], np.mean([np.mean(v) for d, v in by_doy.items() if first[d] == m]))
    assert months.isleap(2024) and first[60] == 3  # day 60 is 1 March in the first year
    assert climatology(f, "chl", "seasonal").table().count() == 4


def test_plot_data(spark):
    data = values()
    f = frame(spark, data)
    for (t, d), v in by_key(timeseries(f, "thetao"), ["time", "depth_idx"], "thetao").items():
        assert math.isclose(v, np.nanmean(data[0][TIMES.index(t), d]))
    assert timeseries(f, "thetao", end=TIMES[0]).count() == 3
    m = by_key(map_at(f, "thetao", TIMES[1], "depth", "max"), ["lat_idx", "lon_idx"], "thetao")
    assert all(v == np.nanmax(data[0][1, :, y, x]) for (y, x), v in m.items())
    for bad in ({"time": TIMES[0]}, {"along": "depth"}, {"time": TIMES[0], "along": "depth", "how": "median"}):
        with pytest.raises(ValueError):
            map_at(f, "thetao", **bad)
