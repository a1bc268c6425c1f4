"""NetCDF and GeoTIFF bytes, ASCII grids made by tasks, and the data source of grid files."""

import io
import os
import struct
import tarfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.grids import DEPTHS, LATS, LONS, TIMES, frame, values
from tidegrid.operators.climatology import climatology
from tidegrid.operators.extract import extract_surface
from tidegrid.sources import netcdf, tiff
from tidegrid.sources.archives import decode
from tidegrid.sources.gridfiles import GridReader, list_members, netcdf_frame, read_grid
from tidegrid.sources.plots import plot_data
from tidegrid.sources.sinks import read_geotiff, write_ascii, write_geotiff, write_netcdf


def _name(s, wide=False):
    raw = s.encode()
    return struct.pack(">q" if wide else ">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def classic(version=1, records=3, packed=True):
    """A file by hand: t is the record dimension, temp is packed in shorts, salt in floats, both on t and y; y has latitudes."""
    n = lambda k: struct.pack(">q" if version == 5 else ">i", k)
    off = lambda k: struct.pack(">i" if version == 1 else ">q", k)
    name = lambda s: _name(s, version == 5)

    def att(k, kind, fmt, *v):
        raw = v[0].encode() if kind == 2 else struct.pack(f">{len(v)}{fmt}", *v)
        return name(k) + struct.pack(">i", kind) + n(len(v[0]) if kind == 2 else len(v)) + raw + b"\0" * (-len(raw) % 4)

    def atts(*a):
        return struct.pack(">i", 12 if a else 0) + n(len(a)) + b"".join(a)

    def build(begins):
        dims = struct.pack(">i", 10) + n(2) + name("time") + n(0) + name("latitude") + n(3)
        var = lambda k, ds, a, kind, size, begin: name(k) + n(len(ds)) + b"".join(n(d) for d in ds) + a + struct.pack(">i", kind) + n(size) + off(begin)
        variables = [
            var("time", [0], atts(att("units", 2, "", "hours since 2020-01-01 06:00:00")), 4, 4, begins[0]), var("latitude", [1], atts(), 5, 12, begins[1]),
            var("temp", [0, 1], atts(att("scale_factor", 6, "d", 0.5), att("add_offset", 6, "d", 10.0), att("_FillValue", 3, "h", -1)), 3, 8, begins[2]), var("salt", [0, 1], atts(), 5, 12, begins[3]),
        ]
        return b"CDF" + bytes([version]) + n(records) + dims + atts(att("title", 2, "", "by hand")) + struct.pack(">i", 11) + n(4) + b"".join(variables)

    head = len(build([0] * 4))
    body, at = struct.pack(">3f", 40, 41, 42), head + 12
    begins = [at, head, at + 4, at + 12]
    for r in range(records):
        body += struct.pack(">i", 24 * r) + struct.pack(">3h", 2 * r, -1, 4) + b"\0\0" + struct.pack(">3f", r, 9.969209968386869e36, r + 0.25)
    return build(begins) + body


@pytest.mark.parametrize("version", [1, 2, 5])
def test_headers_and_values_by_hand(version):
    raw = classic(version)
    asked = []

    def read(at, n):
        asked.append((at, n))
        return raw[at : at + n]

    h = netcdf.read_header(read)
    assert h.dims == {"time": 3, "latitude": 3} and h.unlimited == "time" and h.attributes == {"title": "by hand"} and h.record_size == 24
    asked.clear()
    nan = np.nan
    assert np.array_equal(netcdf.read_values(h, "temp", read, (1,)), [11, nan, 12], equal_nan=True) and asked == [(h.place("temp", (1,)), 6)]
    assert np.array_equal(netcdf.read_values(h, "salt", read), [[0, nan, 0.25], [1, nan, 1.25], [2, nan, 2.25]], equal_nan=True)
    assert np.array_equal(netcdf.read_values(h, "salt", read, (2,), (2, 3)), [2.25]) and asked[-1][1] == 4
    assert netcdf.times_of(netcdf.read_values(h, "time", read), h.variables["time"].attributes["units"]) == [datetime(2020, 1, 1 + k, 6) for k in range(3)]
    for bad in (b"HDF" + raw[3:], b"CDF\x03" + raw[4:], raw[:60]):
        with pytest.raises(ValueError):
            netcdf.read_header(lambda at, n, bad=bad: bad[at : at + n])
    with pytest.raises(ValueError):
        netcdf.read_values(h, "salt", lambda at, n: raw[at : at + n - 1], (0,))
    for units in ("fortnights since 2000-01-01", "days", ""):
        with pytest.raises(ValueError):
            netcdf.times_of(np.zeros(1), units)
    assert netcdf.times_of(np.array([1.5]), "days since 2000-01-01T00:00:00Z") == [datetime(2000, 1, 2, 12)]


def test_netcdf_round_trip(spark, tmp_path):
    f = frame(spark)
    path = str(tmp_path / "a.nc")
    write_netcdf(f, path)
    assert [p.name for p in tmp_path.iterdir()] == ["a.nc"]
    data = values()
    for name, own in zip(("thetao", "so"), data):
        back = netcdf_frame(spark, path, name)
        assert back.axes == f.axes and sorted(r["time"] for r in back.time_axis().collect()) == TIMES
        got = {(r["time"], r["depth_idx"], r["lat_idx"], r["lon_idx"]): r[name] for r in back.table().collect()}
        want = {(TIMES[t], d, y, x): own[t, d, y, x] for t, d, y, x in np.argwhere(~np.isnan(own)).tolist()}
        assert got == want
    t = read_grid(spark, path, "so", between={"time": (TIMES[1], TIMES[1]), "depth": (1.0, None), "latitude": (43.0, 44.9)})
    assert t.count() == np.sum(~np.isnan(data[1][1, 1:, 1:3]))
    with pytest.raises(Exception, match="no variable"):
        read_grid(spark, path, "chl").count()
    flat = extract_surface(f.select(["so"]))
    write_netcdf(flat, str(tmp_path / "flat.nc"))
    assert netcdf_frame(spark, str(tmp_path / "flat.nc"), "so").dims == ("time", "latitude", "longitude")
    made = climatology(f, variable="so", frequency="monthly") if "title" in f.attrs else None
    if made is not None:
        write_netcdf(made, str(tmp_path / "c.nc"))
        raw = (tmp_path / "c.nc").read_bytes()
        h = netcdf.read_header(lambda at, n: raw[at : at + n])
        assert "month" in h.dims or "doy" in h.dims
    series, _ = plot_data(spark, path, "so", "timeseries")
    assert series.count() == 6


def test_only_what_ranges_leave_is_opened(spark, tmp_path):
    f = frame(spark).select(["thetao"])
    folder = tmp_path / "in" / "2025"
    folder.mkdir(parents=True)
    times = [TIMES[0] + timedelta(days=k) for k in range(6)]
    one = f.map(lambda t: t.where(F.col("time") == TIMES[0]).drop("time"))
    write_netcdf(one, str(tmp_path / "one.nc"))
    raw = (tmp_path / "one.nc").read_bytes()
    for t in times:
        (folder / f"ave.{t:%Y%m%d-%H:%M:%S}.thetao.nc").write_bytes(raw)
    with tarfile.open(tmp_path / "in" / "set.tar", "w") as tar:
        for t in times:
            info = tarfile.TarInfo(f"ave.{t:%Y%m%d-%H:%M:%S}.thetao.nc")
            info.size = len(raw)
            tar.addfile(info, io.BytesIO(raw))
    n = int(np.sum(~np.isnan(values()[0][0])))
    for dataset in (None, "set"):
        df = read_grid(spark, str(tmp_path / "in"), "thetao", dataset)
        assert df.columns == ["time", "depth_idx", "depth", "lat_idx", "latitude", "lon_idx", "longitude", "thetao"] and df.count() == 6 * n
        late = read_grid(spark, str(tmp_path / "in"), "thetao", dataset, {"time": (times[4], None)})
        assert late.count() == 2 * n and late.where("latitude = 43.0").count() < 2 * n == late.count() and df.count() == 6 * n
        row = read_grid(spark, str(tmp_path / "in"), "thetao", dataset, {"latitude": (42.5, 43.5), "depth": (None, 1.0), "longitude": (30.0, 31.0)})
        assert row.count() == 6 * np.sum(~np.isnan(values()[0][0, 0, 1, :3]))
    # members out of the range can't even be opened: they are no files any more
    for t in times[:4]:
        os.truncate(folder / f"ave.{t:%Y%m%d-%H:%M:%S}.thetao.nc", 0)
    df = spark.read.format("tidegrid").schema(df.schema).option("path", str(tmp_path / "in")).option("variable", "thetao")
    assert df.option("time", f"{times[4].isoformat()}..").load().count() == 2 * n
    with pytest.raises(Exception):
        df.option("time", "..").load().count()
    with pytest.raises(Exception, match="two dots"):
        df.option("time", "2025").load().count()
    members = list_members(str(tmp_path / "in"), "thetao", "set")
    reader = GridReader(members, "thetao", row.columns, {"time": (times[1], times[3]), "latitude": (43.0, 43.0)})
    assert [p.member.time for p in reader.partitions()] == times[1:4]
    rows = [b for p in reader.partitions() for b in reader.read(p)]
    assert {y for b in rows for y in b.column("latitude").to_pylist()} == {43.0}
    cells = decode(raw)
    assert len(cells) == n and set(cells.columns) == {"depth_idx", "depth", "lat_idx", "latitude", "lon_idx", "longitude", "thetao"}


def test_geotiff_round_trip(spark, tmp_path):
    flat = extract_surface(frame(spark).select(["so"]))
    path = str(tmp_path / "a.tif")
    write_geotiff(flat, path)
    assert [p.name for p in tmp_path.iterdir()] == ["a.tif"]
    data = values()[1][:, 0].mean(axis=0)
    back = read_geotiff(spark, path, "so")
    got = {(r["lat_idx"], r["lon_idx"]): (r["latitude"], r["longitude"], r["so"]) for r in back.table().collect()}
    assert back.values("latitude") == LATS[::-1] and np.allclose(back.values("longitude"), LONS)
    assert len(got) == np.sum(~np.isnan(data))
    for (i, j), (y, x, v) in got.items():
        assert y == LATS[::-1][i] and abs(x - LONS[j]) < 1e-9 and abs(v - data[len(LATS) - 1 - i, j]) < 1e-9
    raw = (tmp_path / "a.tif").read_bytes()
    r = tiff.read_raster(lambda at, n: raw[at : at + n])
    assert (r.width, r.height, r.west, r.north) == (5, 4, 29.75, 45.5) and b"nan\0" in raw
    shown, about = plot_data(spark, path, "so", "map")
    assert shown.count() == len(got) and about["label"] == "Salinity"
    with pytest.raises(ValueError):
        plot_data(spark, path, "so", "timeseries")


def test_geotiff_by_hand(spark, tmp_path):
    """Big-endian, 16-bit, two samples of which the first counts, two rows in a strip, a missing value."""
    pixels = np.arange(12, dtype=">u2").reshape(3, 2, 2)
    strips = [pixels[:2].tobytes(), pixels[2:].tobytes()]
    tags = [(256, 3, [2]), (257, 3, [3]), (258, 3, [16, 16]), (259, 3, [1]), (273, 4, [8, 24]), (277, 3, [2]), (278, 3, [2]), (279, 4, [16, 8]), (33550, 12, [0.5, 0.25, 0.0]), (33922, 12, [0, 0, 0, 10.0, 50.0, 0]), (42113, 2, b"4\0")]
    at = 8 + 24
    body, more, after = struct.pack(">H", len(tags)), b"", at + 2 + 12 * len(tags) + 4
    for tag, kind, v in tags:
        raw = bytes(v) if kind == 2 else struct.pack(f">{len(v)}{ {3: 'H', 4: 'I', 12: 'd'}[kind] }", *v)
        place = raw.ljust(4, b"\0")
        if len(raw) > 4:
            place, more = struct.pack(">I", after + len(more)), more + raw
        body += struct.pack(">HHI", tag, kind, len(v)) + place
    (tmp_path / "b.tif").write_bytes(struct.pack(">2sHI", b"MM", 42, at) + b"".join(strips) + body + struct.pack(">I", 0) + more)
    got = sorted((r["lat_idx"], r["lon_idx"], r["latitude"], r["longitude"], r["band"]) for r in read_geotiff(spark, str(tmp_path / "b.tif")).table().collect())
    assert got == [(0, 0, 49.875, 10.25, 0.0), (0, 1, 49.875, 10.75, 2.0), (1, 1, 49.625, 10.75, 6.0), (2, 0, 49.375, 10.25, 8.0), (2, 1, 49.375, 10.75, 10.0)]
    (tmp_path / "c.tif").write_bytes(b"no picture" * 9)
    with pytest.raises(ValueError):
        read_geotiff(spark, str(tmp_path / "c.tif"))


def test_ascii_of_a_failing_task_leaves_nothing(spark, tmp_path):
    flat = extract_surface(frame(spark).select(["so"]))
    bad = flat.map(lambda t: t.withColumn("so", F.when(F.col("lat_idx") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("so")).cast("double")))
    with pytest.raises(Exception, match="lost"):
        write_ascii(bad, str(tmp_path / "a.asc"))
    assert not list(tmp_path.iterdir()) and len(DEPTHS) == 3
    write_ascii(flat, str(tmp_path / "a.asc"))
    assert [p.name for p in tmp_path.iterdir()] == ["a.asc"]


def test_reductions_by_the_mesh_of_a_model(spark, tmp_path):
    from tidegrid.frame import GridFrame
    from tidegrid.operators.domain import RectangularDomain, cut_to
    from tidegrid.sources.mesh import read_mesh, reduce_by_mesh
    from tidegrid.sources.providers import provider_from

    gen = np.random.default_rng(1)
    e1, e2, e3 = gen.uniform(1, 9, (4, 5)), gen.uniform(1, 9, (4, 5)), gen.uniform(1, 9, (3, 4, 5))
    e3[0, 0, 1] = np.nan  # a cell without a size
    flat = [(y, LATS[y], x, LONS[x], float(e1[y, x]), float(e2[y, x])) for y in range(4) for x in range(5)]
    deep = [(d, DEPTHS[d], y, LATS[y], x, LONS[x], None if np.isnan(e3[d, y, x]) else float(e3[d, y, x]), float((d + x) % 2)) for d in range(3) for y in range(4) for x in range(5)]
    tables = (spark.createDataFrame(flat, "lat_idx int, latitude double, lon_idx int, longitude double, e1t double, e2t double"), spark.createDataFrame(deep, "depth_idx int, depth double, lat_idx int, latitude double, lon_idx int, longitude double, e3t double, tmask double"))
    path = str(tmp_path / "mesh.nc")
    write_netcdf(GridFrame(tables, {"depth": DEPTHS, "latitude": LATS, "longitude": LONS}), path)
    made = read_mesh(spark, path)
    assert made.axes == {"depth": dict(enumerate(DEPTHS)), "latitude": dict(enumerate(LATS)), "longitude": dict(enumerate(LONS))} and made.water.count() == 28
    f, data = frame(spark).select(["so"]), values()[1]
    sizes = {"longitude": e1[None], "latitude": e2[None], "depth": e3}
    for axes in (["longitude"], ["latitude", "longitude"], ["depth"], ["depth", "latitude", "longitude", "time"]):
        weight = np.ones((3, 4, 5))
        for a in axes:
            weight = weight * sizes.get(a, 1)
        over = tuple(("time", "depth", "latitude", "longitude").index(a) for a in axes)
        full = np.where(np.isnan(data) | np.isnan(weight), np.nan, weight)
        want = np.nansum(data * full, axis=over), np.nansum(full, axis=over)
        out = reduce_by_mesh(f, made, axes).table().collect()
        total = sum(r["so"] is not None for r in out)
        assert total == np.sum(want[1] > 0) and abs(sum(r["so"] for r in out if r["so"] is not None) - np.sum(want[0][want[1] > 0] / want[1][want[1] > 0])) < 1e-6
    cut = reduce_by_mesh(cut_to(f, RectangularDomain("b", (43.0, 44.0), (30.0, 31.0))), made, ["longitude"], "integral").table()
    assert {r["lat_idx"] for r in cut.collect()} <= {1, 2}
    for axes, how in ((["height"], "mean"), (["depth"], "median")):
        with pytest.raises(ValueError):
            reduce_by_mesh(f, made, axes, how)
    write_netcdf(f, str(tmp_path / "none.nc"))
    with pytest.raises(ValueError):
        read_mesh(spark, str(tmp_path / "none.nc"))
    (tmp_path / "p.yaml").write_text(f"kind: local\nsource: {tmp_path}\nmeshmask: {{type: netcdf, path: {path}}}\nvariables:\n- variable: so\nfrequencies:\n- frequency: daily\n  variables: [so]\n  path: day\n")
    assert provider_from(tmp_path / "p.yaml").mesh(spark).axes == made.axes


def test_listing_of_variables_by_provider_and_frequency(spark, tmp_path, capsys):
    from tidegrid.__main__ import main

    (tmp_path / "p.yaml").write_text("kind: local\nname: one\nvariables:\n- variable: so\n- variable: chl\nfrequencies:\n- frequency: daily\n  variables: [so]\n  path: day\n- frequency: monthly\n  variables: [so, chl]\n  path: month\n")
    assert main(["variables", "--provider", str(tmp_path / "p.yaml"), "--frequency", "daily"]) == 0
    said = capsys.readouterr().out
    assert "Practical Salinity" in said and "Chlorophyll" not in said
    assert main(["variables", "--provider", str(tmp_path / "p.yaml")]) == 0
    assert capsys.readouterr().out.count("Practical Salinity") == 2
    with pytest.raises(SystemExit):
        main(["variables", "--frequency", "daily"])
