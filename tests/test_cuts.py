"""Actions after cuts: indices, axes and the time axis survive them."""

import json
import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from tests.grids import DEPTHS, LATS, LONS, TIMES, by_key, frame, values
from tidegrid.functions.calendar import lead_parts
from tidegrid.operators.bottom_map import BottomCellMap, nearest_water
from tidegrid.operators.climatology import climatology
from tidegrid.operators.domain import RectangularDomain, cut_to
from tidegrid.operators.extract import extract_bottom, extract_surface
from tidegrid.operators.reduce import compute_depth_average, compute_depth_integral, reduce_axes
from tidegrid.operators.stats import calculate_stats
from tidegrid.sources.collection import Collection
from tidegrid.sources.plots import plot_data
from tidegrid.sources.providers import Provider, ingest, read_config
from tidegrid.sources.sinks import ascii_header, ascii_lines, write_ascii, write_parquet

CELL = ["time", "lat_idx", "lon_idx"]


def close(a, b):
    assert a.keys() == b.keys()
    assert all((a[k] is None and b[k] is None) or math.isclose(a[k], b[k], rel_tol=1e-12) for k in a)


def test_a_depth_slice_weighs_as_the_arguments_do(spark):
    f = frame(spark)
    for action in (compute_depth_average, compute_depth_integral):
        close(by_key(action(f.between("depth", 2.0, 5.0)).table(), CELL, "so"), by_key(action(f, 2.0, 5.0).table(), CELL, "so"))


@pytest.mark.parametrize("operator", ["mean", "integral", "max"])
def test_a_latitude_slice_weighs_as_the_domain_does(spark, operator):
    f = frame(spark)
    sliced = reduce_axes(f.between("latitude", 43.0, 45.0).between("longitude", 30.5, 31.5), ["latitude", "longitude"], operator=operator)
    inside = reduce_axes(cut_to(f, RectangularDomain("box", (43.0, 45.0), (30.5, 31.5))), ["latitude", "longitude"], operator=operator)
    close(by_key(sliced.table(), ["time", "depth_idx"], "thetao"), by_key(inside.table(), ["time", "depth_idx"], "thetao"))


def test_a_domain_keeps_the_time_axis(spark):
    times = [datetime(2024, m, 1) for m in range(1, 7)]
    data = values(times)
    data[:, 2, :, 1, 1] = np.nan  # one cell lacks March
    f = cut_to(frame(spark, data, times, "monthly means"), RectangularDomain("cell", (43.0, 43.0), (30.5, 30.5)))
    got = by_key(climatology(f, "thetao", "monthly").table(), ["month", "depth_idx"], "thetao")
    assert {m for m, _ in got} == set(range(1, 7)) and got[3, 0] == 0.0
    assert {r["thetao_mean"] for r in calculate_stats(f, ["mean"]).table().collect()} == {None}
    # at the first step of the axis nothing is there: the column then gets the last level
    late = cut_to(frame(spark, data[:, 2:], times[2:], "monthly means"), RectangularDomain("cell", (43.0, 43.0), (30.5, 30.5)))
    assert extract_bottom(late.select(["thetao"])).table().count() == late.table().where("depth_idx = 2").count()


def test_surface_bottom_and_ascii_after_a_slice(spark):
    data = values()
    f = frame(spark, data).between("depth", 2.0, 5.0).between("latitude", 43.0, 44.0)
    surface = by_key(extract_surface(f).table(), CELL, "so")
    assert all(v == data[1][TIMES.index(t), 1, y, x] for (t, y, x), v in surface.items()) and len(surface) == 2 * (~np.isnan(data[1][0, 1, 1:3])).sum()
    for (t, y, x), v in by_key(extract_bottom(f.select(["thetao"])).table(), CELL, "thetao").items():
        column = data[0][TIMES.index(t), 1:, y, x]
        assert v == column[(~np.isnan(column)).sum() - 1]
    flat = extract_surface(f.select(["so"]))
    lines = [r["line"].split() for r in ascii_lines(flat).orderBy("row").collect()]
    want = data[1][:, 1, 1:3].mean(axis=0)
    assert np.allclose(np.array(lines, float), np.where(np.isnan(want), -9999, want)[::-1], atol=1e-7)
    assert ascii_header(flat)[1] == "nrows 2"


def test_bottom_of_several_variables_is_one_table(spark, tmp_path):
    data = values()
    data[1, :, 2] = np.nan  # so ends a level earlier
    f = frame(spark, data)
    both = extract_bottom(f)
    for i, v in enumerate(("thetao", "so")):
        one = by_key(extract_bottom(f.select([v])).table(), CELL, v)
        got = by_key(both.table(), CELL, v)
        assert {k: x for k, x in got.items() if x is not None} == one
    write_parquet(both, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "time_latitude_longitude")).count() == both.table().count()


def test_tables_of_equal_dimensions_are_written_as_one(spark, tmp_path):
    f = extract_surface(frame(spark, flat=True))
    write_parquet(f, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out" / "time_latitude_longitude"))
    assert set(back.columns) >= {"thetao", "so", "mlotst"} and back.where("thetao = mlotst").count() == back.count() == f.table_of("so").count()


class Cells(Provider):
    kind = "cells-of-tests"

    def __init__(self, f):
        self.f = f

    def available_variables(self, frequency):
        return ["thetao", "so"]

    def read(self, spark, variable, frequency, start, end):
        return self.f.select([variable]).between("time", start, end).table()

    def describe(self):
        return "cells"


def test_a_box_keeps_the_indices_of_the_grid(spark, tmp_path):
    times = [datetime(2024, 1, 31), datetime(2024, 2, 1), datetime(2024, 4, 1)]
    data = values(times)
    f = frame(spark, data, times)
    box = RectangularDomain("Box", (43.0, 45.0), (30.5, 31.5), (2.0, 5.0))
    made = ingest(spark, tmp_path / "c", box, ["thetao", "so"], "daily", datetime(2024, 1, 1), datetime(2024, 4, 30), Cells(f), "month")
    assert made.axes == {"depth": {1: 2.0, 2: 5.0}, "latitude": {1: 43.0, 2: 44.0, 3: 45.0}, "longitude": {1: 30.5, 2: 31.0, 3: 31.5}}
    assert len(made.files["so"]) == 4 and sorted(p.name for p in (tmp_path / "c").iterdir() if p.name.startswith("tmp")) == []
    got = by_key(reduce_axes(Collection.load(tmp_path / "c").frame(spark), ["depth", "latitude", "longitude"]).table(), ["time"], "so")
    want = by_key(reduce_axes(cut_to(f.between("depth", 2.0, 5.0), box), ["depth", "latitude", "longitude"]).table(), ["time"], "so")
    close(got, want)
    assert {t for (t,) in got} == set(times)


def test_longitudes_are_snapped_in_the_scan(spark, tmp_path):
    for v, x in (("thetao", 1.4e-13), ("so", -1.2e-13)):
        rows = [(TIMES[0], 0, 42.0, 0, x, 1.0), (TIMES[0], 0, 42.0, 1, 0.5, 2.0)]
        spark.createDataFrame(rows, f"time timestamp_ntz, lat_idx int, latitude double, lon_idx int, longitude double, {v} double").write.parquet(str(tmp_path / v))
    from tidegrid.sources.collection import DataFile

    files = {v: [DataFile(TIMES[0], TIMES[0], v, v)] for v in ("thetao", "so")}
    Collection("Box", TIMES[0], TIMES[0], "daily", "test", files, {"latitude": [42.0], "longitude": [1.4e-13, 0.5]}).save(tmp_path)
    f = Collection.load(tmp_path).frame(spark)
    assert {r["longitude"] for r in f.table().collect()} == {0.0, 0.5} and f.values("longitude") == [0.0, 0.5]


def test_ascii_as_older_tools_write_it(spark, tmp_path):
    flat = extract_surface(frame(spark).select(["so"]))
    write_ascii(flat, str(tmp_path / "a.asc"), compat=True)
    write_ascii(flat, str(tmp_path / "b.asc"))
    old, new = ((tmp_path / n).read_text().splitlines() for n in ("a.asc", "b.asc"))
    assert old[:6] == ["ncols 4", "nrows 5", "xllcorner 30.0", "yllcorner 42.0", "cellsize 0.75", "NODATA_value -9999"] and old[6:] == new[:5:-1]


CONFIG = """
name: {name}
start_date: 1999-01-01
end_date: 2022-12-31
source:
  type: local
meshmask:
  type: grid
  path: "/data/meshmask.nc"
variables:
  - variable: thetao
    dataset_name: votemper
    unit: "°C"
  - variable: so
    unit: null
frequencies:
  - frequency: monthly
    variables: [thetao, so]
    path: "/data/AVE_FREQ_2_tar"
"""


def test_provider_files_with_whole_paths(tmp_path):
    (tmp_path / "a.yaml").write_text(CONFIG.format(name="archive"))
    c = read_config(tmp_path / "a.yaml")
    assert (c.name, c.kind, c.variables, c.frequencies) == ("archive", "tar", {"thetao": "votemper", "so": "so"}, {"monthly": (["thetao", "so"], "/data/AVE_FREQ_2_tar")})
    assert c.units == {"thetao": "°C", "so": None} and c.meshmask["type"] == "grid" and c.start.year == 1999
    text = CONFIG.format(name="archive")
    for i, bad in enumerate([text.replace("type: local", "type: remote"), text.replace("  type: grid\n", ""), text.replace("unit: null", "units: null"), text + "  - frequency: monthly\n    variables: [so]\n    path: /x\n"]):
        (tmp_path / f"{i}.yaml").write_text(bad)
        with pytest.raises(ValueError):
            read_config(tmp_path / f"{i}.yaml")
    with pytest.raises(FileNotFoundError):
        read_config(tmp_path / "nowhere.yaml")


def test_plots_by_kind_of_file(spark, tmp_path):
    f = frame(spark)
    f.select(["so"]).table().write.parquet(str(tmp_path / "so.parquet"))
    data, about = plot_data(spark, str(tmp_path / "so.parquet"), "so", "timeseries", end=TIMES[0])
    assert about == {"label": "Salinity", "unit": "PSU", "cmap": "viridis"} and data.count() == 3
    m, _ = plot_data(spark, str(tmp_path / "so.parquet"), "so", "map", time=TIMES[1], along="depth", how="max")
    assert m.count() == 16
    (tmp_path / "t.csv").write_text("time,so\n2025-01-02,2.0\n2025-01-01,1.0\n")
    t, about = plot_data(spark, str(tmp_path / "t.csv"), "so", "timeseries")
    assert [r["so"] for r in t.collect()] == [1.0, 2.0] and about["label"] == "Practical Salinity"
    (tmp_path / "x.tif").write_text("")
    (tmp_path / "u.csv").write_text("depth,so\n1,2.0\n")
    for path, v, mode in (("t.csv", "so", "map"), ("t.csv", "chl", "timeseries"), ("u.csv", "so", "timeseries"), ("x.tif", "so", "map"), ("so.parquet", "chl", "map"), ("so.parquet", "so", "sound")):
        with pytest.raises(ValueError):
            plot_data(spark, str(tmp_path / path), v, mode)
    with pytest.raises(FileNotFoundError):
        plot_data(spark, str(tmp_path / "none.csv"), "so", "timeseries")
    from tidegrid.__main__ import main

    assert main(["plot", "timeseries", "--input-file", str(tmp_path / "so.parquet"), "--variable", "so", "--output-dir", str(tmp_path / "out")]) == 0
    assert json.loads((tmp_path / "out" / "so_timeseries.json").read_text())["unit"] == "PSU" and spark.read.csv(str(tmp_path / "out" / "so_timeseries"), header=True).count() == 6


def test_a_mapped_functions_schema_is_inferred(spark):
    points = spark.createDataFrame([(1, 43.1, 30.6, TIMES[1]), (2, 44.0, 31.0, datetime(1999, 1, 1)), (3, 43.1, 30.6, TIMES[1])], "pid long, latitude double, longitude double, time timestamp_ntz")

    def func(series: pd.DataFrame) -> dict:
        return {"n": len(series), "mean": float(series["so"].mean()) if len(series) else None, "name": "x"}

    out = BottomCellMap(frame(spark).select(["so"]), timedelta(days=3)).map(func, points)
    assert dict(out.dtypes)["n"] == "bigint" and dict(out.dtypes)["mean"] == "double" and dict(out.dtypes)["name"] == "string"
    assert {r["pid"]: r["n"] for r in out.collect()} == {1: 2, 2: 0, 3: 2}


def test_tiles_follow_the_grid(spark):
    water = spark.createDataFrame([(i, j, 40 + i / 24, 10 + j / 24) for i in range(20) for j in range(20)], "lat_idx int, lon_idx int, latitude double, longitude double")
    points = spark.createDataFrame([(k, 40 + k % 7 / 10, 10 + k % 5 / 9) for k in range(40)] + [(99, 50.0, 30.0)], "pid long, latitude double, longitude double")
    fine, wide = ({r["pid"]: (r["lat_idx"], r["lon_idx"]) for r in nearest_water(points, water, tile=t).collect()} for t in (None, 360.0))
    assert fine == wide and len(fine) == 41


def test_lead_parts(spark):
    t = spark.createDataFrame([("a", TIMES[1]), ("a", TIMES[0]), ("b", TIMES[0])], "v string, time timestamp_ntz")
    assert [tuple(r) for r in lead_parts(t, ["v"]).collect()] == [("a", TIMES[0], TIMES[1])]
    assert DEPTHS and LATS and LONS
