"""Plans that hold on large tables: what is asked how often, and what is sent whole to every task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.grids import DEPTHS, LATS, LONS, frame
from tidegrid.frame import GridFrame
from tidegrid.operators import domain as domains
from tidegrid.operators import regions
from tidegrid.operators.domain import MultiPolygonalDomain, PolygonalDomain, cut_to


def _ragged(n):
    """A ring of 2 n vertices around the middle of the small grid, with a ragged south and north."""
    x = np.linspace(29.9, 31.6, n)
    south = [(float(a), 42.2 + (7919 * i) % 101 / 60) for i, a in enumerate(x)]
    north = [(float(a), 44.1 + (6007 * i) % 89 / 60) for i, a in enumerate(x)]
    return (*south, *reversed(north))


def _nodes(plan):
    yield plan
    children = plan.children()
    for k in range(children.size()):
        yield from _nodes(children.apply(k))


def test_a_large_ring_is_not_asked_for_each_row_that_cells_are_made_of(spark):
    rows = spark.range(4000).selectExpr("cast(id % 4 as int) lat_idx", "cast(id % 5 as int) lon_idx", "cast(id as double) thetao")
    cells = rows.groupBy("lat_idx", "lon_idx").agg(F.avg("thetao").alias("thetao")).withColumns({"latitude": 42.0 + F.col("lat_idx"), "longitude": 30.0 + F.col("lon_idx") * 0.5})
    domain = PolygonalDomain("ragged", _ragged(400))
    out = cut_to(GridFrame((cells,), {"latitude": LATS, "longitude": LONS}), domain).table()
    sums = [x for x in _nodes(out._jdf.queryExecution().optimizedPlan()) if x.nodeName() == "Aggregate"]
    assert sums and not any("lambda" in x.toString() for x in sums)
    want = [(r["latitude"], r["longitude"], r["thetao"]) for r in cells.where(domain.mask(F.col("latitude"), F.col("longitude"))).collect()]
    assert sorted((r["latitude"], r["longitude"], r["thetao"]) for r in out.collect()) == sorted(want) and 0 < len(want) < 20
    assert out.columns == cells.columns


@pytest.mark.parametrize("most", [domains.BROADCAST_PLACES, 0])
def test_a_cut_by_places_is_that_of_each_cell(spark, monkeypatch, most):
    monkeypatch.setattr(domains, "BROADCAST_PLACES", most)
    ragged = PolygonalDomain("ragged", _ragged(40))
    square = PolygonalDomain("square", ((31.9, 42.5), (32.1, 42.5), (32.1, 43.5), (31.9, 43.5)))
    t = frame(spark).table()
    moved = t.withColumns({"latitude": F.when(F.col("lat_idx") == 1, F.col("latitude") + 0.9).when(F.col("lat_idx") != 3, F.col("latitude")), "lon_idx": F.when(F.col("lon_idx") == 3, 77).otherwise(F.col("lon_idx"))})
    axes = {"depth": DEPTHS, "latitude": {0: 42.0, 1: 43.0, 2: 44.0, 3: 45.0}, "longitude": LONS}
    for domain in (ragged, MultiPolygonalDomain("both", (ragged, square))):
        for table in (t, moved):
            want = sorted(map(tuple, table.where(domain.mask(F.col("latitude"), F.col("longitude"))).collect()), key=repr)
            for known in (axes, axes | {"latitude": {0: 42.0, 2: 44.0}}, axes | {"longitude": [170.0]}, {}):
                out = cut_to(GridFrame((table,), known), domain).table()
                assert sorted(map(tuple, out.collect()), key=repr) == want and out.columns == table.columns
            assert want


def test_a_cut_of_a_large_grid_joins_places_only_where_a_place_meets_many_edges(spark, monkeypatch):
    monkeypatch.setattr(domains, "BROADCAST_PLACES", 0)
    a = np.linspace(0, 2 * np.pi, 400, endpoint=False)
    smooth = PolygonalDomain("smooth", tuple(zip((31 + 0.8 * np.cos(a)).tolist(), (43.5 + 1.2 * np.sin(a)).tolist())))
    ragged = PolygonalDomain("ragged", _ragged(200))
    assert smooth.corners() == ragged.corners() == 400 and smooth.compared() < 1 and ragged.compared() > 16
    for domain, joined in ((smooth, False), (ragged, True)):
        plan = cut_to(frame(spark), domain).table()._jdf.queryExecution().optimizedPlan()
        assert any(x.nodeName() == "Join" for x in _nodes(plan)) == joined


@pytest.mark.parametrize("most", [regions.BROADCAST_POINTS, 0])
def test_what_polygons_are_made_into_is_not_sent_to_every_task(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(regions, "BROADCAST_POINTS", most)
    spark.range(300).write.parquet(f"{tmp_path}/made")  # a few KB; the edges by rows of tiles are thousands of times as large
    corners = [(0.2, 0.0), (0.1, 0.1), (0.0, 0.3), (-0.1, 0.1), (-0.2, 0.0), (0.0, -0.3)]
    ring = F.array(*[F.struct((F.col("id") % 7 * 0.05 + x).alias("x"), (F.col("id") % 11 * 0.05 + y).alias("y")) for x, y in corners])
    polygons = spark.read.parquet(f"{tmp_path}/made").select(F.col("id").alias("polygon"), ring.alias("ring"))
    places = [(x / 10, y / 10) for x in range(-3, 6) for y in range(-3, 8)]
    out = regions.points_in_polygons(spark.createDataFrame(places, "x double, y double"), polygons)
    sent = [x for x in _nodes(out._jdf.queryExecution().sparkPlan()) if x.nodeName() == "BroadcastHashJoin"]
    whole = [x.children().apply(0 if "BuildLeft" in x.toString().split("\n")[0] else 1) for x in sent]
    assert not any("polygon" in x.output().toString() for x in whole) and bool(sent) == bool(most)
    want = set()
    for r in polygons.collect():
        edges = [(a["x"], a["y"], b["x"], b["y"]) for a, b in zip(r["ring"], [*r["ring"][1:], r["ring"][0]]) if a["y"] != b["y"]]
        for x, y in places:
            if sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in edges) % 2:
                want.add((x, y, r["polygon"]))
    got = [(r["x"], r["y"], r["polygon"]) for r in out.collect()]
    assert set(got) == want and len(got) == len(want) > 300
