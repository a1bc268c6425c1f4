import io
import tarfile
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.grids import SCHEMA, TIMES, frame, values
from tidegrid.functions import calendar
from tidegrid.operators.bottom_map import BottomCellMap, nearest_water
from tidegrid.operators.domain import BoundingBox, MultiPolygonalDomain, PolygonalDomain, RectangularDomain, basin_domain, cut_to
from tidegrid.sources import filenames
from tidegrid.sources.archives import local_archive, tar_archive
from tidegrid.sources.collection import Collection, DataFile, missing_files, snap_longitudes, validate, wanted_files
from tidegrid.sources.domains import read_domain, ring_of_wkt
from tidegrid.sources.sinks import ascii_header, csv_table, write_ascii, write_csv
from tidegrid.sources.tables import csv_variables, read_csv
from tidegrid.sources.variables import REGISTRY, Registry, Variable, variables_table


def inside(ring, x, y):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def test_domains(spark):
    gen = np.random.default_rng(1)
    points = spark.createDataFrame([(float(x), float(y)) for x, y in gen.uniform(0, 10, (400, 2))], "longitude double, latitude double")
    star = ((1.0, 1.0), (9.0, 2.0), (5.0, 4.0), (8.0, 9.0), (2.0, 7.0))
    tri = ((6.0, 0.5), (9.5, 0.5), (9.5, 3.0))
    both = MultiPolygonalDomain("both", (PolygonalDomain("star", star), PolygonalDomain("tri", tri)))
    got = points.withColumn("m", both.mask(F.col("latitude"), F.col("longitude"))).collect()
    assert all(r["m"] == (inside(star, r["longitude"], r["latitude"]) or inside(tri, r["longitude"], r["latitude"])) for r in got)
    assert points.where(MultiPolygonalDomain("none", ()).mask(F.col("latitude"), F.col("longitude"))).count() == 0
    f = frame(spark)
    kept = cut_to(f, RectangularDomain("box", (43.0, 44.0), (30.5, 31.0))).table()
    assert {(r["latitude"], r["longitude"]) for r in kept.collect()} <= {(a, b) for a in (43.0, 44.0) for b in (30.5, 31.0)}
    assert BoundingBox.merge([BoundingBox((0, 1), (2, 3), (0, 5)), BoundingBox((-1, 0), (9, 9))]) == BoundingBox((-1, 1), (2, 9), None)
    with pytest.raises(ValueError):
        BoundingBox.merge([])
    with pytest.raises(ValueError):
        RectangularDomain("no spaces", (0, 1), (0, 1))


def test_basins_are_expanded_once():
    basins = {"a": [(0, 0), (1, 0), (0, 1)], "b": [(5, 5), (6, 5), (5, 6)], "ab": ["a", "b"], "all": ["ab", "a", "all"]}
    assert [p.ring for p in basin_domain(basins, "all").polygons] == [((0, 0), (1, 0), (0, 1)), ((5, 5), (6, 5), (5, 6))]
    with pytest.raises(ValueError):
        basin_domain(basins, "c")


def test_domain_files(tmp_path):
    (tmp_path / "r.yaml").write_text("name: Box\ngeometry:\n  type: Rectangle\n  min_latitude: 1\n  max_latitude: 2\n  min_longitude: 3\n  max_longitude: 4\ndepth:\n  min_depth: 0\n  max_depth: 50\n")
    assert read_domain(tmp_path / "r.yaml") == RectangularDomain("Box", (1, 2), (3, 4), (0, 50))
    (tmp_path / "p.csv").write_text('WKT,nome,descrizione\n"POLYGON ((12.0 44.9, 12.4 44.6, 13.8 44.6, 12.0 44.9))",North,\n')
    (tmp_path / "w.yaml").write_text("name: North\ngeometry:\n  type: wkt\n  file: p.csv\n")
    assert read_domain(tmp_path / "w.yaml").ring[1] == (12.4, 44.6)
    (tmp_path / "n.yaml").write_text("name: Nothing\n")
    with pytest.raises(ValueError):
        read_domain(tmp_path / "n.yaml")
    with pytest.raises(ValueError):
        ring_of_wkt("LINESTRING (0 0, 1 1)")


@settings(max_examples=50)
@given(st.datetimes(datetime(1950, 1, 1), datetime(2100, 1, 1)), st.integers(0, 4000), st.sampled_from(["thetao", "ph", "so"]), st.sampled_from(["daily", "monthly"]))
def test_file_names_round_trip(start, days, variable, frequency):
    start = datetime(start.year, start.month, start.day)
    made = filenames.data_file_name("Adriatic-Sea", variable, frequency, start, start + timedelta(days=days))
    assert filenames.parse_data_file_name(made) == {"domain": "Adriatic-Sea", "variable": variable, "frequency": frequency, "start": start, "end": start + timedelta(days=days)}


def test_file_name_columns(spark):
    t = spark.createDataFrame([("A_thetao_daily_2020-01-01--2020-02-01.nc",), ("other.nc",)], "name string")
    rows = t.select("name", *filenames.data_file_parts(F.col("name"))).collect()
    assert rows[0]["variable"] == "thetao" and str(rows[0]["end"]) == "2020-02-01" and rows[1]["domain"] is None
    with pytest.raises(ValueError):
        filenames.parse_data_file_name("other.nc")


@settings(max_examples=60)
@given(st.datetimes(datetime(1990, 1, 1), datetime(2030, 1, 1)), st.integers(0, 2000), st.sampled_from(["month", "year"]))
def test_intervals_tile_the_time(start, days, by):
    start = start.replace(microsecond=0)
    end = start + timedelta(days=days)
    parts = calendar.split_interval(start, end, by)
    if start == end:
        assert parts == []
        return
    assert parts[0][0] == start and parts[-1][1] == end
    for (_, b), (c, _) in zip(parts, parts[1:]):
        assert c - b == timedelta(seconds=1) and c.day == 1 and (by == "month" or c.month == 1)


def test_intervals_of_a_table_match(spark):
    gen = np.random.default_rng(4)
    spans = [(i, datetime(2000, 1, 1) + timedelta(days=int(a)), datetime(2000, 1, 1) + timedelta(days=int(a + n))) for i, (a, n) in enumerate(gen.integers(0, 900, (30, 2)))]
    spans += [(90, datetime(2001, 1, 1), datetime(2001, 1, 1)), (91, datetime(2001, 1, 1), datetime(2002, 1, 1)), (92, datetime(2001, 1, 31, 5), datetime(2001, 2, 1))]
    t = spark.createDataFrame(spans, "k int, start timestamp_ntz, end timestamp_ntz")
    for by in ("month", "year"):
        got = sorted((r["k"], r["part_start"], r["part_end"]) for r in calendar.split_intervals(t, by).collect())
        assert got == sorted((k, a, b) for k, s, e in spans for a, b in calendar.split_interval(s, e, by))
    with pytest.raises(Exception, match="after its end"):
        calendar.split_intervals(spark.createDataFrame([(1, TIMES[1], TIMES[0])], "k int, start timestamp_ntz, end timestamp_ntz"), "month").collect()
    with pytest.raises(ValueError):
        calendar.split_interval(TIMES[1], TIMES[0], "month")
    with pytest.raises(ValueError):
        calendar.n_time_steps(F.col("start"), F.col("end"), "weekly")


def test_collection_round_trip(spark, tmp_path):
    f = frame(spark, flat=True)
    paths = {}
    for v in ("thetao", "so", "mlotst"):
        f.select([v]).table().write.parquet(str(tmp_path / v))
        paths[v] = [DataFile(TIMES[0], TIMES[1], v, v)]
    c = Collection("Box", TIMES[0], TIMES[1], "daily", "test", paths, f.axes, "daily means")
    c.save(tmp_path)
    with pytest.raises(FileExistsError):
        c.save(tmp_path)
    again = Collection.load(tmp_path)
    assert again.variables() == ["thetao", "so", "mlotst"] and again.paths("so") == [str(tmp_path / "so")]
    read = again.frame(spark)
    assert read.table_of("thetao").count() == f.table_of("thetao").count() and len(read.tables) == 2
    assert again.frame(spark, ["so"], end=TIMES[0]).table().select("time").distinct().count() == 1
    assert again.mask(spark).count() > 0
    with pytest.raises(ValueError):
        again.frame(spark, [])
    with pytest.raises(FileNotFoundError):
        Collection.load(tmp_path / "nowhere")


def test_validation_and_resume(spark):
    t = frame(spark).table()
    assert validate(t, "thetao", (0.0, 10.0)).first()["ok"] and not validate(t, "thetao", (0.0, 1.0)).first()["ok"]
    assert not validate(t.drop("time"), "thetao").first()["ok"]
    wanted = wanted_files(spark, "Box", ["thetao", "so"], "daily", calendar.split_interval(datetime(2020, 1, 1), datetime(2020, 3, 5), "month"))
    assert wanted.count() == 6
    present = spark.createDataFrame([("Box_so_daily_2020-01-01--2020-01-31.nc",)], "name string")
    assert missing_files(wanted, present).count() == 5
    assert {r["longitude"] for r in snap_longitudes(spark.createDataFrame([(1e-9,), (-1e-8,), (0.5,)], "longitude double")).collect()} == {0.0, 0.5}


def test_archives(spark, tmp_path):
    data = values()
    rows = [(t, 0, 42.0 + y, y, float(data[0][i, 0, y, 1])) for i, t in enumerate(TIMES) for y in range(4)]
    schema = "time timestamp_ntz, lat_idx int, latitude double, thetao double"
    with tarfile.open(tmp_path / "set.tar", "w") as tar:
        for t in TIMES:
            raw = io.BytesIO()
            pd.DataFrame([(y, 42.0 + y, v) for tt, _, _, y, v in rows if tt == t], columns=["lat_idx", "latitude", "thetao"]).to_parquet(raw)
            name = f"ave.{t:%Y%m%d-%H:%M:%S}.thetao.parquet"
            (tmp_path / "loose").mkdir(exist_ok=True)
            (tmp_path / "loose" / name).write_bytes(raw.getvalue())
            info = tarfile.TarInfo(name)
            info.size = len(raw.getvalue())
            tar.addfile(info, io.BytesIO(raw.getvalue()))
    expected = sorted((t, y, v) for t, _, _, y, v in rows)
    for df in (local_archive(spark, str(tmp_path / "loose"), "thetao", schema), tar_archive(spark, str(tmp_path), "set", "thetao", schema)):
        assert sorted((r["time"], r["lat_idx"], r["thetao"]) for r in df.collect()) == [(a, b, c) for a, b, c in expected]
    assert local_archive(spark, str(tmp_path / "loose"), "thetao", schema, start=TIMES[1]).count() == 4
    with pytest.raises(ValueError):
        local_archive(spark, str(tmp_path / "loose"), "so", schema)


def test_sinks(spark, tmp_path):
    f = frame(spark)
    with pytest.raises(ValueError):
        csv_table(f)
    one = f.select(["so"])
    write_csv(one, str(tmp_path / "csv"))
    back = read_csv(spark, str(tmp_path / "csv"))
    assert back.columns == ["time", "depth", "latitude", "longitude", "so"] and back.count() == one.table().where("so is not null").count() and csv_variables(back) == ["so"]
    from tidegrid.operators.extract import extract_surface

    flat = extract_surface(one)
    write_ascii(flat, str(tmp_path / "grid.asc"))
    lines = (tmp_path / "grid.asc").read_text().splitlines()
    assert lines[:2] == ["ncols 5", "nrows 4"] and len(lines) == 10 and lines[4] == "cellsize 0.75000000"
    data = values()[1][:, 0].mean(axis=0)
    got = [[float(x) for x in line.split()] for line in lines[6:]]
    assert np.allclose(got, np.where(np.isnan(data), -9999, data)[::-1], atol=1e-7)
    assert ascii_header(flat)[5] == "NODATA_value -9999"
    with pytest.raises(ValueError):
        write_ascii(one, str(tmp_path / "x.asc"))


def test_nearest_water_and_bottom_map(spark):
    gen = np.random.default_rng(9)
    f = frame(spark)
    wet = sorted({(r["lat_idx"], r["lon_idx"], r["latitude"], r["longitude"]) for r in f.table().collect()})
    water = spark.createDataFrame(wet, "lat_idx int, lon_idx int, latitude double, longitude double")
    pts = [(i, float(a), float(b), TIMES[1] + timedelta(hours=1)) for i, (a, b) in enumerate(np.column_stack([gen.uniform(30, 60, 60), gen.uniform(10, 50, 60)]))] + [(99, None, 1.0, TIMES[0])]
    points = spark.createDataFrame(pts, "pid long, latitude double, longitude double, time timestamp_ntz")

    def metres(a, b, c, d):
        a, b, c, d = map(np.radians, (a, b, c, d))
        h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
        return round(float(2 * 6_371_000 * np.arcsin(np.sqrt(h))), 3)

    got = {r["pid"]: r for r in nearest_water(points, water, tile=0.25).collect()}
    assert len(got) == 60
    for pid, y, x, _ in pts[:-1]:
        d, i, j = min((metres(y, x, c[2], c[3]), c[0], c[1]) for c in wet)
        assert (got[pid]["lat_idx"], got[pid]["lon_idx"]) == (i, j) and abs(got[pid]["distance"] - d) < 0.01
    data = values()
    out = BottomCellMap(f.select(["thetao"]), timedelta(days=1)).map(lambda s: {"n": len(s), "last": float(s["thetao"].iloc[-1]) if len(s) else None}, points, "n long, last double")
    rows = {r["pid"]: r for r in out.collect()}
    assert len(rows) == 61 and rows[99]["n"] == 0
    for pid, *_ in pts[:-1]:
        column = data[0][1, :, got[pid]["lat_idx"], got[pid]["lon_idx"]]
        assert rows[pid]["n"] == 1 and rows[pid]["last"] == column[(~np.isnan(column)).sum() - 1]


def test_variables(spark):
    assert len(REGISTRY.all()) == 30 and REGISTRY.get("chl").label == "Chlorophyll-a"
    with pytest.raises(ValueError):
        REGISTRY.get("xyz")
    with pytest.raises(ValueError):
        Registry().add(Variable("so", "again"))
    with pytest.raises(ValueError):
        REGISTRY.check(["so", "so"])
    assert [r["name"] for r in variables_table(spark, ["so", "chl"]).collect()] == ["chl", "so"]
    assert "thetao double" in SCHEMA
