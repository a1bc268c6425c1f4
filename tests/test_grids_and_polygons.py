"""Grids of different coordinates, polygons of any size, shapefiles, and collections in many files."""

import json
import math
import struct
import zipfile
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.grids import TIMES, frame
from tidegrid.frame import GridFrame
from tidegrid.functions.calendar import split_interval
from tidegrid.functions.geo import in_polygon
from tidegrid.operators.align import align_frames, align_outer, one_numbering, reconciled, union_axis
from tidegrid.operators.domain import MultiPolygonalDomain, PolygonalDomain, RectangularDomain, cut_to, from_geometry, of_rings, to_geometry
from tidegrid.operators.reduce import reduce_axes
from tidegrid.operators.regions import points_in_polygons
from tidegrid.sources import providers
from tidegrid.sources.collection import Collection, DataFile
from tidegrid.sources.domains import read_domain
from tidegrid.sources.shapefile import read_shapes, select_shape


def test_union_of_axes():
    values, (a, b) = union_axis([{0: 42.0, 1: 43.0}, {0: 42.5, 1: 43.0000001, 2: 43.5}])
    assert values == {0: 42.0, 1: 42.5, 2: 43.0, 3: 43.5} and (a, b) == ({0: 0, 1: 2}, {0: 1, 1: 2, 2: 3})
    falling, _ = union_axis([{0: 3.0, 1: 1.0}, {0: 2.0, 1: 0.0}])
    assert list(falling.values()) == [3.0, 2.0, 1.0, 0.0]
    with pytest.raises(ValueError):
        union_axis([{0: 1.0, 1: 1.0 + 1e-9}])
    assert one_numbering([{0: 1.0, 1: 2.0}, {2: 3.0}]) == {0: 1.0, 1: 2.0, 2: 3.0}
    assert one_numbering([{0: 1.0, 1: 2.0}, {2: 1.5}]) is None and one_numbering([{0: 1.0}, {0: 1.5}]) is None and one_numbering([{0: 1.0}, {1: 1.0}]) is None
    grid, remaps = reconciled([{"depth": {0: 1.0}, "latitude": {0: 5.0}}, {"latitude": {0: 6.0}}])
    assert grid == {"depth": {0: 1.0}, "latitude": {0: 5.0, 1: 6.0}} and remaps == [{"latitude": {0: 0}}, {"latitude": {0: 1}}]


def _flat(spark, variable, lats, first=0):
    rows = [(t, i + first, y, 0, 30.0, 10.0 * i + k) for k, t in enumerate(TIMES) for i, y in enumerate(lats)]
    t = spark.createDataFrame(rows, f"time timestamp_ntz, lat_idx int, latitude double, lon_idx int, longitude double, {variable} double")
    return GridFrame((t,), {"latitude": {i + first: y for i, y in enumerate(lats)}, "longitude": [30.0]})


def test_variables_on_different_grids(spark):
    a, b = _flat(spark, "thetao", [42.0, 43.0, 44.0]), _flat(spark, "chl", [42.5, 43.0, 43.5])
    with pytest.raises(Exception, match="different grids"):
        align_outer([a.table(), b.table()]).collect()
    out = align_frames([a, b])
    rows = {(r["time"], r["latitude"]): (r["lat_idx"], r["thetao"], r["chl"]) for r in out.table().collect()}
    assert out.values("latitude") == [42.0, 42.5, 43.0, 43.5, 44.0] == sorted({y for _, y in rows})
    assert rows[TIMES[0], 43.0] == (2, 10.0, 10.0) and rows[TIMES[1], 42.5] == (1, None, 1.0) and rows[TIMES[1], 44.0] == (4, 21.0, None) and len(rows) == 10
    assert out.time_axis().count() == 2
    same = align_frames([a, _flat(spark, "chl", [44.0, 45.0], 2)])
    assert same.axes["latitude"] == {0: 42.0, 1: 43.0, 2: 44.0, 3: 45.0} and same.table().count() == 8
    mean = reduce_axes(out.select(["chl"]), ["latitude"], operator="max").table().collect()
    assert sorted(r["chl"] for r in mean) == [20.0, 21.0]


def _ring(n, seed=0):
    gen = np.random.default_rng(seed)
    a = np.sort(gen.uniform(0, 2 * math.pi, n))
    r = 1 + 0.4 * np.sin(5 * a) + gen.uniform(0, 0.3 / n**0.5, n)
    return [(float(q * math.cos(t)), float(q * math.sin(t))) for q, t in zip(r, a)]


def _inside(ring, x, y):
    out = np.zeros(len(x), bool)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 != y2:
            out ^= ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return out


def _points(n, seed=1):
    gen = np.random.default_rng(seed)
    return gen.uniform(-2, 2, n), gen.uniform(-2, 2, n)


@pytest.mark.parametrize("ring", [_ring(3), _ring(300), _ring(3000), [(0, 0), (1, 0), (1, 1), (0, 1)], [(0, 0), (1, 0), (1, 1), (0.5, 1), (0.5, 0.5), (0.2, 0.5), (0.2, 1), (0, 1), (0, 0)], [(0, 0), (2, 0), (1, 0)]])
def test_polygons_match_brute_force(spark, ring):
    x, y = _points(3000)
    on = np.array([0, 0.2, 0.5, 1.0, 1.5])
    x, y = np.concatenate([x, np.repeat(on, 5), [p[0] for p in ring[:50]]]), np.concatenate([y, np.tile(on, 5), [p[1] for p in ring[:50]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(-1, None, 0.5), (-2, 0.5, None)], "i int, x double, y double")
    got = {r["i"] for r in df.where(in_polygon(F.col("x"), F.col("y"), ring)).collect()}
    assert got == set(np.flatnonzero(_inside(ring, x, y)).tolist())
    rows = spark.createDataFrame([(7, [(float(a), float(b)) for a, b in ring])], "polygon long, ring array<struct<x: double, y: double>>")
    want = {(float(a), float(b)) for a, b, k in zip(x, y, _inside(ring, x, y)) if k}
    for tile in (None, 0.3):
        assert {(r["x"], r["y"]) for r in points_in_polygons(df, rows, tile).collect()} == want


def test_a_ring_of_fifty_thousand_vertices(spark):
    ring = _ring(50_000)
    x, y = _points(300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "longitude double, latitude double")
    domain = PolygonalDomain("Coast", tuple(ring))
    got = df.where(domain.mask(F.col("latitude"), F.col("longitude"))).count()
    assert got == _inside(ring, x, y).sum()
    assert from_geometry(json.loads(json.dumps(to_geometry(domain)))) == domain


def test_a_table_of_a_thousand_polygons(spark):
    gen = np.random.default_rng(2)
    rings = [[(float(a + cx), float(b + cy)) for a, b in _ring(int(gen.integers(3, 30)), k)] for k, (cx, cy) in enumerate(gen.uniform(-20, 20, (1000, 2)))]
    x, y = gen.uniform(-20, 20, 500), gen.uniform(-20, 20, 500)
    polygons = spark.createDataFrame([(k, [{"x": a, "y": b} for a, b in r]) for k, r in enumerate(rings)] + [(-1, None), (-2, [])], "polygon long, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] * 2 + [(None, 1.0)], "x double, y double")
    got = sorted((r["x"], r["y"], r["polygon"]) for r in points_in_polygons(points, polygons).collect())
    want = sorted((float(x[i]), float(y[i]), k) for k, r in enumerate(rings) for i in np.flatnonzero(_inside(r, x, y)))
    assert got == want and len(want) > 500


# shapefiles


def _shp(records, kind=5):
    body = b""
    for n, rings in enumerate(records):
        if rings is None:
            content = struct.pack("<i", 0)
        else:
            points = [p for r in rings for p in r]
            xs, ys = [p[0] for p in points], [p[1] for p in points]
            first = np.cumsum([0, *map(len, rings)])[:-1]
            content = struct.pack("<i4dii", kind, min(xs), min(ys), max(xs), max(ys), len(rings), len(points)) + struct.pack(f"<{len(rings)}i", *first) + b"".join(struct.pack("<2d", *p) for p in points)
            if kind == 15:
                content += struct.pack(f"<{2 + len(points)}d", *[0.0] * (2 + len(points)))
        body += struct.pack(">ii", n + 1, len(content) // 2) + content
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<ii8d", 1000, kind, *[0.0] * 8) + body


def _dbf(rows):
    fields = [(b"CODE", b"C", 8, 0), (b"AREA", b"N", 6, 2), (b"N", b"N", 4, 0)]
    head = b"".join(n.ljust(11, b"\0") + k + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, k, w, d in fields) + b"\r"
    body = b"".join(b" " + c.encode().ljust(8) + (f"{a:6.2f}" if a is not None else " " * 6).encode() + f"{n:4d}".encode() for c, a, n in rows)
    return struct.pack("<4BIHH20x", 3, 125, 1, 1, len(rows), 32 + len(head), 19) + head + body


CLOCKWISE = ((0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0))
HOLE = ((1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0))
SECOND = ((10.0, 0.0), (10.0, 1.0), (11.0, 1.0), (10.0, 0.0))


def test_shapefiles(tmp_path):
    rows = [("GSA08", None, 1), ("GSA09", 2.5, 2), ("GSA10", 1.0, 3)]
    for kind in (5, 15):
        shp, dbf = _shp([None, [CLOCKWISE, HOLE, SECOND], [HOLE]], kind), _dbf(rows)
        (tmp_path / "a.shp").write_bytes(shp)
        (tmp_path / "a.dbf").write_bytes(dbf)
        with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
            z.writestr("in/a.shp", shp), z.writestr("in/a.dbf", dbf), z.writestr("in/a.prj", "")
        for name in ("a.shp", "a.zip"):
            shapes = read_shapes(tmp_path / name)
            assert [s.attributes for s in shapes] == [{"CODE": c, "AREA": a, "N": n} for c, a, n in rows]
            assert shapes[0].outer == () and shapes[1].outer == (CLOCKWISE, SECOND) and shapes[1].holes == (HOLE,) and shapes[2].outer == (HOLE,)
    assert select_shape(tmp_path / "a.zip", "CODE", "GSA10").outer == (HOLE,)
    for field, value in (("CODE", "GSA99"), ("NAME", "x"), ("CODE", "GSA08")):
        with pytest.raises(ValueError):
            select_shape(tmp_path / "a.zip", field, value)
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("a.shp", shp), z.writestr("b.shp", shp)
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("a.txt", "")
    (tmp_path / "cut.shp").write_bytes(shp[:-40])
    (tmp_path / "points.shp").write_bytes(shp[:32] + struct.pack("<i", 1) + shp[36:])
    (tmp_path / "other.shp").write_bytes(b"x" * 200)
    for name in ("two.zip", "none.zip", "cut.shp", "points.shp", "other.shp"):
        with pytest.raises(ValueError):
            read_shapes(tmp_path / name)


def test_shapefile_domains(spark, tmp_path):
    (tmp_path / "data").mkdir(), (tmp_path / "domains").mkdir()
    with zipfile.ZipFile(tmp_path / "data" / "a.zip", "w") as z:
        z.writestr("a.shp", _shp([[CLOCKWISE, HOLE], [CLOCKWISE, SECOND]])), z.writestr("a.dbf", _dbf([("GSA09", 1.0, 1), ("GSA10", 1.0, 2)]))
    text = "name: GSA9\ngeometry:\n  type: shapefile\n  file_path: \"${{MAIN_DIR}}/data/a.zip\"\n  selection_field_name: CODE\n  selection_field_value: {}\ndepth:\n  min_depth: 1.5\n  max_depth: 20\n"
    (tmp_path / "domains" / "one.yaml").write_text(text.format("GSA09"))
    (tmp_path / "domains" / "two.yaml").write_text(text.format("GSA10"))
    one, two = read_domain(tmp_path / "domains" / "one.yaml"), read_domain(tmp_path / "domains" / "two.yaml")
    assert isinstance(one, PolygonalDomain) and one.box().longitude == (0.0, 4.0) and one.depth == (1.5, 20.0) and isinstance(two, MultiPolygonalDomain)
    points = spark.createDataFrame([(1.5, 1.5), (10.2, 0.8), (5.0, 5.0)], "longitude double, latitude double")
    inside = lambda d: sorted(r["longitude"] for r in points.where(d.mask(F.col("latitude"), F.col("longitude"))).collect())
    assert inside(one) == [1.5] and inside(two) == [1.5, 10.2]  # holes don't count
    assert from_geometry(to_geometry(two)) == two
    with pytest.raises(ValueError):
        of_rings("none", [])


# collections in many files


class _Months(providers.Provider):
    """A value for each month, and half a second before the next one."""

    kind = "months"
    reads = 0

    def available_variables(self, frequency):
        return ["thetao", "chl"]

    def read(self, spark, variable, frequency, start, end):
        _Months.reads += 1
        months = spark.range((end.year - start.year) * 12 + 12).select(F.make_timestamp_ntz((F.lit(start.year) + F.col("id") / 12).cast("int"), (F.col("id") % 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("time"))
        late = months.select((F.add_months(F.col("time"), 1).cast("timestamp_ntz") - F.expr("interval 500 millisecond")).alias("time"))
        rows = months.union(late).where((F.col("time") >= start) & (F.col("time") <= end))
        shift = 0.5 if variable == "chl" else 0.0
        return rows.withColumn("y", F.explode(F.array(F.lit(0), F.lit(1)))).select("time", F.col("y").alias("lat_idx"), (F.col("y") + 42.0 + shift).alias("latitude"), F.lit(0).alias("lon_idx"), F.lit(30.0).alias("longitude"), F.unix_timestamp("time").cast("double").alias(variable))

    def describe(self):
        return "months"


BOX = RectangularDomain("Box", (42.0, 44.0), (29.0, 31.0))


def test_ingest_of_eighteen_hundred_months(spark, tmp_path):
    start, end = datetime(1950, 1, 1), datetime(2099, 12, 31, 23, 59, 59, 999999)
    parts = split_interval(start, end, "month")
    files = [DataFile(a, b, "thetao", f"file={a:%Y-%m}.parquet") for a, b in parts]
    cells = _Months().read(spark, "thetao", "monthly", start, end)
    named = providers.with_file(cells, files, files)
    assert len(parts) == 1800
    rows = named.groupBy("file").count().collect()
    assert len(rows) == 1800 and {r["count"] for r in rows} == {4}  # the last half second of each month too
    assert named.where(F.date_format("time", "yyyy-MM") != F.substring("file", 1, 7)).count() == 0
    some = [files[3], files[900]]
    assert providers.with_file(cells, some, files).count() == 8


def test_resume_reads_no_data_of_files_that_are_there(spark, tmp_path):
    made = providers.ingest(spark, tmp_path / "c", BOX, ["thetao", "chl"], "monthly", datetime(1990, 1, 1), datetime(1993, 12, 31), _Months(), "month")
    assert [f.rows for f in made.files["thetao"]] == [4] * 47 + [2]  # the last month ends at midnight of its last day
    reads, jobs = _Months.reads, spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("resume", "nothing to do")
    again = providers.resume(spark, tmp_path / "c", BOX, _Months())
    assert _Months.reads == reads and not jobs.getJobIdsForGroup("resume")
    spark.sparkContext._jsc.clearJobGroup()
    assert again.files == made.files and len(again.grids) == 2 and again.axes["latitude"] == [42.0, 42.5, 43.0, 43.5]
    table = again.frame(spark).table()
    rows = table.where(F.col("time") == datetime(1991, 5, 1)).collect()
    assert sorted((r["latitude"], r["thetao"] is None, r["chl"] is None) for r in rows) == [(42.0, False, True), (42.5, True, False), (43.0, False, True), (43.5, True, False)]
    # only the files of two months are read, and none whose latitudes lie elsewhere
    assert len(again.wanted("thetao", datetime(1991, 2, 1), datetime(1991, 3, 15))) == 2 and not again.wanted("thetao", ranges={"latitude": (42.2, 42.8)})
    part = again.frame(spark, ["thetao"], datetime(1991, 2, 1), datetime(1991, 3, 15), {"latitude": (42.0, 42.5)}).table()
    assert len(part.inputFiles()) < 10 and part.count() == 3
    assert again.frame(spark, ["thetao"], ranges={"latitude": (42.2, 42.8)}).table().count() == 0
    # one file is lost: only it is made again
    f = again.files["chl"][7]
    (tmp_path / "c" / f.path / "_SUCCESS").unlink()
    for part_file in (tmp_path / "c" / f.path).glob("*.parquet"):
        part_file.unlink()
    third = providers.resume(spark, tmp_path / "c", BOX, _Months())
    assert third.files == made.files and third.frame(spark, ["chl"]).table().count() == sum(x.rows for x in made.files["chl"])


def test_a_failing_ingestion_leaves_nothing(spark, tmp_path):
    class Failing(_Months):
        kind = "failing"
        bad = True

        def read(self, *a):
            cells = super().read(*a)
            return cells.withColumn("thetao", F.when(F.lit(self.bad) & (F.month("time") == 7), F.raise_error(F.lit("lost"))).otherwise(F.col("thetao")).cast("double"))

    provider = Failing()
    with pytest.raises(Exception, match="lost"):
        providers.ingest(spark, tmp_path / "c", BOX, ["thetao"], "monthly", datetime(1990, 1, 1), datetime(1990, 12, 31), provider, "month")
    assert not list((tmp_path / "c").rglob("*.parquet/*"))
    provider.bad = False
    made = providers.resume(spark, tmp_path / "c", BOX, provider)
    assert made.frame(spark).table().count() == sum(f.rows for f in made.files["thetao"]) == 12 * 2 + 11 * 2


def test_polygonal_collections_are_cut_to_their_polygon(spark, tmp_path):
    class Cells(providers.Provider):
        kind = "cells"

        def available_variables(self, frequency):
            return ["so"]

        def read(self, spark, variable, frequency, start, end):
            return frame(spark).select(["so"]).table()

        def describe(self):
            return ""

    triangle = PolygonalDomain("Tri", ((29.9, 41.9), (32.1, 41.9), (29.9, 45.1)))
    providers.ingest(spark, tmp_path / "c", triangle, ["so"], "daily", TIMES[0], TIMES[1] + timedelta(days=1), Cells())
    made = Collection.load(tmp_path / "c")
    assert made.region == triangle
    whole = made.frame(spark)
    got, want = made.inside(whole).table().count(), cut_to(frame(spark).select(["so"]), triangle).table().count()
    assert got == want < whole.table().count()
    from tidegrid.__main__ import main

    assert main(["reduce", "reduce_axes", 'axes=["time","depth","latitude","longitude"]', "operator=max", "--dataset", str(tmp_path / "c"), "--output", str(tmp_path / "out"), "--format", "parquet"]) == 0
    best = spark.read.parquet(str(tmp_path / "out" / "scalar")).first()["so"]
    assert best == cut_to(frame(spark).select(["so"]), triangle).table().agg(F.max("so")).first()[0]
    assert replace(made, region=None).inside(whole) is whole


# the nearest cell, and series of cells


def test_nearest_cells_of_a_global_grid(spark):
    from tidegrid.operators.bottom_map import nearest_water

    gen = np.random.default_rng(3)
    lats, lons = np.arange(-90, 91, 15.0), np.arange(-180, 180, 15.0)
    wet = [(i, j, float(y), float(x)) for i, y in enumerate(lats) for j, x in enumerate(lons) if gen.random() < 0.5]
    points = [(179.9, 10.0), (-179.9, 10.0), (180.0, -89.9), (33.0, 90.0), (359.0, 0.0), (-200.0, 41.0)] + list(zip(gen.uniform(-180, 180, 80), gen.uniform(-90, 90, 80)))
    df = spark.createDataFrame([(k, float(y), float(x)) for k, (x, y) in enumerate(points)] * 1 + [(999, None, 1.0)], "pid long, latitude double, longitude double")
    water = spark.createDataFrame(wet, "lat_idx int, lon_idx int, latitude double, longitude double")

    def metres(y, x):
        a, b = np.radians(y), np.radians([c[2] for c in wet])
        h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians([c[3] for c in wet] - np.float64(x)) / 2) ** 2
        return np.round(2 * 6_371_000 * np.arcsin(np.minimum(1, np.sqrt(h))), 3)

    for tile in (None, 4.0):
        got = {r["pid"]: r for r in nearest_water(df, water, tile=tile).collect()}
        assert len(got) == len(points)
        for k, (x, y) in enumerate(points):
            assert abs(got[k]["distance"] - metres(y, x).min()) < 0.01
    few = spark.createDataFrame([(0, 0, 0.0, 0.0)], water.schema)
    assert {r["pid"] for r in nearest_water(df.limit(7), few).collect()} == set(range(7)) and nearest_water(df, few.where("false")).count() == 0


def test_series_of_a_hot_cell(spark):
    from tidegrid.operators.bottom_map import BottomCellMap

    start = datetime(2020, 1, 1)
    steps = spark.createDataFrame([(start + timedelta(hours=6 * k), 0, 42.0, 0, 30.0, float(k)) for k in range(400)], "time timestamp_ntz, lat_idx int, latitude double, lon_idx int, longitude double, chl double")
    f = GridFrame((steps,), {"latitude": [42.0], "longitude": [30.0]})
    points = spark.range(20_000).select(F.col("id").alias("pid"), F.lit(42.1).alias("latitude"), F.lit(30.0).alias("longitude"), (F.lit(start) + F.make_dt_interval(mins=(F.col("id") % 7000) * 30)).cast("timestamp_ntz").alias("time"))
    points = points.withColumn("time", F.when(F.col("pid") != 5, F.col("time")))
    out = BottomCellMap(f, timedelta(days=1)).series(points)
    got = {r["pid"]: (r["n"], r["last"]) for r in out.groupBy("pid").agg(F.count("model_time").alias("n"), F.max("chl").alias("last")).collect()}
    assert len(got) == 20_000 and got[5] == (0, None)
    for pid in (0, 1, 12, 47, 48, 100, 4799, 4800, 4850, 6999, 19_999):
        hours = (pid % 7000) * 0.5
        own = [k for k in range(400) if hours - 24 <= 6 * k <= hours]
        assert got[pid] == (len(own), float(max(own)) if own else None)
