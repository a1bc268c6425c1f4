"""The registered queries of the grid engine, with DuckDB SQL for each.

Measured values are rounded to six decimals on both sides: engines add in different orders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import COLUMNS, GridFrame, at_index
from ..functions import calendar
from ..functions.layers import layer_heights_table
from ..operators.actions import run_action
from ..operators.align import align_frames, align_outer, with_mask
from ..operators.bottom_map import BottomCellMap, nearest_water
from ..operators.domain import MultiPolygonalDomain, PolygonalDomain, RectangularDomain, cut_to
from ..operators.extract import first_time, nearest_time, water_mask
from ..operators.plotdata import map_at, timeseries
from ..operators.regions import points_in_polygons
from ..lineage import shared_folder
from ..sources import collection, filenames, gridfiles, mesh, providers
from ..sources.sinks import ascii_lines, csv_table, raster, read_geotiff, write_ascii, write_geotiff, write_netcdf
from ..sources.tables import DEPTHS, LATITUDES, LONGITUDES, daily_cube, monthly_cube, order_points
from ..sources.variables import KNOWN, variables_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

_MON = """
mon as (select cast(date_trunc('month', l_shipdate) as timestamp) "time", cast(l_linenumber - 1 as integer) depth_idx, cast(l_suppkey % 4 as integer) lat_idx,
               cast(l_partkey % 5 as integer) lon_idx, avg(l_quantity) thetao, avg(l_extendedprice) so
        from lineitem where l_linenumber <= 7 - ((l_suppkey % 4) * 5 + l_partkey % 5) % 8 group by 1, 2, 3, 4),
cube as (select *, ([0.5, 2, 5, 10, 20, 40, 80]::double[])[depth_idx + 1] depth, ([1, 2, 4, 6, 14, 26, 54]::double[])[depth_idx + 1] h,
                42.0::double + lat_idx latitude, 30.0::double + lon_idx * 0.5::double longitude,
                (sin(radians(42.5::double + lat_idx)) - sin(radians(41.5::double + lat_idx))) * 6371000.0::double * 6371000.0::double * radians(0.5::double) area from mon)"""
_DAY = """
days as (select cast(date_trunc('day', l_shipdate) as timestamp) "time", cast(l_suppkey % 2 as integer) lat_idx, cast(l_partkey % 2 as integer) lon_idx, avg(l_quantity) chl
         from lineitem group by 1, 2, 3),
times as (select distinct "time" from days),
firsts as (select cast(dayofyear("time") as integer) doy, arg_min(cast(month("time") as integer), "time") "month" from times group by 1),
doys as (select d.doy, f."month", lat_idx, lon_idx, chl from (select cast(dayofyear("time") as integer) doy, lat_idx, lon_idx, avg(chl) chl from days group by 1, 2, 3) d join firsts f using (doy))"""
_POINTS = """
points as (select o_orderkey pid, 42.0::double + o_custkey % 31 * 0.1::double latitude, 30.0::double + o_custkey % 21 * 0.1::double longitude, cast(o_orderdate as timestamp) "time" from orders),
wet as (select distinct lat_idx, lon_idx, latitude, longitude from cube where "time" = (select min("time") from cube)),
dist as (select pid, p."time", w.lat_idx, w.lon_idx,
                round(2 * 6371000.0::double * asin(least(sqrt(pow(sin(radians(w.latitude - p.latitude) / 2), 2) + cos(radians(p.latitude)) * cos(radians(w.latitude)) * pow(sin(radians(w.longitude - p.longitude) / 2), 2)), 1.0::double)), 3) distance
         from points p cross join wet w),
near as (select * from (select *, row_number() over (partition by pid order by distance, lat_idx, lon_idx) k from dist) where k = 1),
t0 as (select lat_idx, lon_idx, count(thetao) n from cube where "time" = (select min("time") from cube) group by 1, 2),
bottom as (select c.lat_idx, c.lon_idx, cast(case when coalesce(t0.n, 0) = 0 then 6 else t0.n - 1 end as integer) bottom_idx from (select distinct lat_idx, lon_idx from cube) c left join t0 using (lat_idx, lon_idx))"""
_SEASON = "case when m in (12, 1, 2) then 'DJF' when m in (3, 4, 5) then 'MAM' when m in (6, 7, 8) then 'JJA' else 'SON' end"


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name], _SQL[name] = f, sql
        return f

    return add


def _tidy(t: DataFrame, *values: str, drop: tuple[str, ...] = ("depth", "latitude", "longitude"), digits: int = 6) -> DataFrame:
    return t.drop(*[c for c in drop if c in t.columns]).withColumns({v: F.round(F.col(v).cast("double"), digits) for v in values})


def _reduced(name: str, axes: list[str], operator: str, keys: str, value: str, scale: float = 1.0, where: str = "true", **depth: float) -> None:
    """Register a reduction of thetao and its SQL."""
    by = f"group by {keys}" if keys else ""
    sql = f"with {_MON} select {keys + ', ' if keys else ''}round({value} / {scale}, 6) thetao from cube where {where} {by}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frame = monthly_cube(spark, sf_dir).select(["thetao"])
        out = run_action("reduce_axes", frame, axes=axes, operator=operator, **depth).table()
        return _tidy(out.withColumn("thetao", F.col("thetao") / F.lit(scale)), "thetao")

    _query(name, sql)(run)


_CELL = '"time", depth_idx, lat_idx, lon_idx'
_reduced("reduce_lat_mean", ["latitude"], "mean", '"time", depth_idx, lon_idx', "sum(thetao * latitude) / sum(latitude)")
_reduced("reduce_lon_mean", ["longitude"], "mean", '"time", depth_idx, lat_idx', "sum(thetao * longitude) / sum(longitude)")
_reduced("reduce_lat_integral", ["latitude"], "integral", '"time", depth_idx, lon_idx', "sum(thetao * latitude)")
_reduced("reduce_lon_integral", ["longitude"], "integral", '"time", depth_idx, lat_idx', "sum(thetao * longitude)")
_reduced("reduce_latlon_mean", ["latitude", "longitude"], "mean", '"time", depth_idx', "sum(thetao * area) / sum(area)")
_reduced("reduce_latlon_integral", ["latitude", "longitude"], "integral", '"time", depth_idx', "sum(thetao * area)", 1e10)
_reduced("reduce_time_mean", ["time"], "mean", "depth_idx, lat_idx, lon_idx", "avg(thetao)")
_reduced("reduce_time_integral", ["time"], "integral", "depth_idx, lat_idx, lon_idx", "sum(thetao)")
_reduced("reduce_depth_time_mean", ["depth", "time"], "mean", "lat_idx, lon_idx", "sum(thetao * h) / sum(h)")
_reduced("reduce_volume_mean", ["depth", "latitude", "longitude"], "mean", '"time"', "sum(thetao * area * h) / sum(area * h)")
_reduced("reduce_volume_integral", ["depth", "latitude", "longitude"], "integral", '"time"', "sum(thetao * area * h)", 1e12)
_reduced("reduce_all_mean", ["time", "depth", "latitude", "longitude"], "mean", "", "sum(thetao * area * h) / sum(area * h)")
_reduced("reduce_all_integral", ["time", "depth", "latitude", "longitude"], "integral", "", "sum(thetao * area * h)", 1e14)
for _how in ("max", "min"):
    _reduced(f"reduce_depth_{_how}", ["depth"], _how, '"time", lat_idx, lon_idx', f"{_how}(thetao)")
    _reduced(f"reduce_latlon_{_how}", ["latitude", "longitude"], _how, '"time", depth_idx', f"{_how}(thetao)")
    _reduced(f"reduce_time_{_how}", ["time"], _how, "depth_idx, lat_idx, lon_idx", f"{_how}(thetao)")
    _reduced(f"reduce_all_{_how}", ["time", "depth", "latitude", "longitude"], _how, "", f"{_how}(thetao)")
# depths 2 to 20 have heights 4, 2, 8, 12 of their own: the first reaches to the surface
_CUT = "([0, 4, 2, 8, 12, 0, 0]::double[])[depth_idx + 1]"
_reduced("depth_average_range", ["depth"], "mean", '"time", lat_idx, lon_idx', f"sum(thetao * {_CUT}) / sum({_CUT})", where="depth between 2 and 20", depth_min=2.0, depth_max=20.0)
_reduced("depth_integral_range", ["depth"], "integral", '"time", lat_idx, lon_idx', f"sum(thetao * {_CUT})", where="depth between 2 and 20", depth_min=2.0, depth_max=20.0)


@_query("depth_average", f'with {_MON} select "time", lat_idx, lon_idx, round(sum(thetao * h) / sum(h), 6) thetao, round(sum(so * h) / sum(h), 6) so from cube group by 1, 2, 3')
def depth_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(run_action("compute_depth_average", monthly_cube(spark, sf_dir)).table(), "thetao", "so")


@_query("depth_integral", f'with {_MON} select "time", lat_idx, lon_idx, round(sum(thetao * h), 6) thetao, round(sum(so * h), 6) so from cube group by 1, 2, 3')
def depth_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(run_action("compute_depth_integral", monthly_cube(spark, sf_dir)).table(), "thetao", "so")


def _stats(name: str, operations: list[str], columns: dict[str, str]) -> None:
    whole = "case when count(thetao) = max(n) then round({}, 6) end"
    values = ", ".join(f"{whole.format(sql)} {c}" for c, sql in columns.items())
    sql = f'with {_MON}, steps as (select count(distinct "time") n from cube) select depth_idx, lat_idx, lon_idx, {values} from cube cross join steps group by 1, 2, 3'

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _tidy(run_action("calculate_stats", monthly_cube(spark, sf_dir).select(["thetao"]), operations=operations).table(), *columns)

    _query(name, sql)(run)


_QUART = {f"thetao_quartiles_{p}": f"quantile_cont(thetao, {p / 100})" for p in (5, 25, 75, 95)}
_stats("stats_mean", ["mean"], {"thetao_mean": "avg(thetao)"})
_stats("stats_variance", ["variance"], {"thetao_variance": "var_pop(thetao)"})
_stats("stats_median", ["median"], {"thetao_median": "median(thetao)"})
_stats("stats_minmax", ["minimum", "maximum"], {"thetao_minimum": "min(thetao)", "thetao_maximum": "max(thetao)"})
_stats("stats_quartiles", ["quartiles"], _QUART)
_stats("stats_all", ["all"], {"thetao_mean": "avg(thetao)", "thetao_variance": "var_pop(thetao)", "thetao_median": "median(thetao)", "thetao_minimum": "min(thetao)", "thetao_maximum": "max(thetao)"} | _QUART)


@_query(
    "clim_monthly_from_monthly",
    f"""with {_MON}, t as (select distinct "time" from cube), w as (select cast(month("time") as integer) "month", sum(day(last_day("time"))) nd from t group by 1),
    g as (select cast(month("time") as integer) "month", depth_idx, lat_idx, lon_idx, sum(thetao * day(last_day("time"))) total from cube group by 1, 2, 3, 4)
    select w."month", c.depth_idx, c.lat_idx, c.lon_idx, round(coalesce(g.total, 0) / w.nd, 6) thetao
    from w cross join (select distinct depth_idx, lat_idx, lon_idx from cube) c left join g on g."month" = w."month" and g.depth_idx = c.depth_idx and g.lat_idx = c.lat_idx and g.lon_idx = c.lon_idx""",
)
def clim_monthly_from_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(run_action("climatology", monthly_cube(spark, sf_dir), variable="thetao", frequency="monthly").table(), "thetao")


@_query(
    "clim_monthly_from_monthly_1996_1998",
    f"""with {_MON}, part as (select * from cube where "time" between timestamp '1996-01-01' and timestamp '1998-12-31'), t as (select distinct "time" from part), w as (select cast(month("time") as integer) "month", sum(day(last_day("time"))) nd from t group by 1),
    g as (select cast(month("time") as integer) "month", depth_idx, lat_idx, lon_idx, sum(so * day(last_day("time"))) total from part group by 1, 2, 3, 4)
    select w."month", c.depth_idx, c.lat_idx, c.lon_idx, round(coalesce(g.total, 0) / w.nd, 6) so
    from w cross join (select distinct depth_idx, lat_idx, lon_idx from part) c left join g on g."month" = w."month" and g.depth_idx = c.depth_idx and g.lat_idx = c.lat_idx and g.lon_idx = c.lon_idx""",
)
def clim_monthly_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = monthly_cube(spark, sf_dir)
    return _tidy(run_action("climatology", frame, variable="so", frequency="monthly", start_date=datetime(1996, 1, 1), end_date=datetime(1998, 12, 31)).table(), "so")


@_query("clim_seasonal_from_monthly", f'with {_MON}, s as (select *, month("time") m from cube) select {_SEASON} season, depth_idx, lat_idx, lon_idx, round(avg(thetao), 6) thetao from s group by 1, 2, 3, 4')
def clim_seasonal_from_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(run_action("climatology", monthly_cube(spark, sf_dir), variable="thetao", frequency="seasonal").table(), "thetao")


@_query("clim_daily_from_daily", f'with {_DAY} select doy, "month", lat_idx, lon_idx, round(chl, 6) chl from doys')
def clim_daily_from_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(run_action("climatology", daily_cube(spark, sf_dir), variable="chl", frequency="daily").table(), "chl")


@_query("clim_monthly_from_daily", f'with {_DAY} select "month", lat_idx, lon_idx, round(avg(chl), 6) chl from doys group by 1, 2, 3')
def clim_monthly_from_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(run_action("climatology", daily_cube(spark, sf_dir), variable="chl", frequency="monthly").table(), "chl")


@_query("clim_seasonal_from_daily", f'with {_DAY}, s as (select *, "month" m from doys) select {_SEASON} season, lat_idx, lon_idx, round(avg(chl), 6) chl from s group by 1, 2, 3')
def clim_seasonal_from_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(run_action("climatology", daily_cube(spark, sf_dir), variable="chl", frequency="seasonal").table(), "chl")


_EXTREMES = ", ".join(f"round({f}({v}), 6) {v}_{f}" for v in ("thetao", "so") for f in ("min", "max"))
_BOTH = ("thetao_min", "thetao_max", "so_min", "so_max")


@_query("extremes", f"""with {_MON} select cast(date_trunc('year', "time") as timestamp) "time", {_EXTREMES} from cube group by 1""")
def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(run_action("extract_annual_extremes", monthly_cube(spark, sf_dir)).table(), *_BOTH)


@_query("extremes_per_layer", f"""with {_MON} select cast(date_trunc('year', "time") as timestamp) "time", depth_idx, {_EXTREMES} from cube group by 1, 2""")
def extremes_per_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(run_action("extract_annual_extremes_per_layer", monthly_cube(spark, sf_dir)).table(), *_BOTH)


_VALUES = "round(thetao, 6) thetao, round(so, 6) so"


@_query("surface", f'with {_MON} select "time", lat_idx, lon_idx, {_VALUES} from cube where depth_idx = 0')
def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(run_action("extract_surface", monthly_cube(spark, sf_dir)).table(), "thetao", "so")


@_query("layer_nearest", f'with {_MON} select "time", lat_idx, lon_idx, {_VALUES} from cube where depth_idx = 4')
def layer_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15 m lies half-way between 10 and 20."""
    return _tidy(run_action("extract_layer", monthly_cube(spark, sf_dir), depth=15.0).table(), "thetao", "so")


@_query("bottom", f'with {_MON}, {_POINTS} select "time", lat_idx, lon_idx, round(thetao, 6) thetao from cube join bottom using (lat_idx, lon_idx) where depth_idx = bottom_idx')
def bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(run_action("extract_bottom", monthly_cube(spark, sf_dir).select(["thetao"])).table(), "thetao")


@_query("mask", f'with {_MON} select depth_idx, lat_idx, lon_idx, true tmask from cube where "time" = (select min("time") from cube)')
def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(water_mask(monthly_cube(spark, sf_dir)))


@_query(
    "masked_cells",
    f'with {_MON}, m as (select distinct depth_idx, lat_idx, lon_idx, true t from cube where "time" = (select min("time") from cube)) select {_CELL}, round(thetao, 6) thetao, coalesce(t, false) tmask from cube left join m using (depth_idx, lat_idx, lon_idx)',
)
def masked_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = monthly_cube(spark, sf_dir).select(["thetao"])
    return _tidy(with_mask(frame.table(), water_mask(frame)), "thetao").select("time", "depth_idx", "lat_idx", "lon_idx", "thetao", "tmask")


def _domain(name: str, domain, condition: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _tidy(cut_to(monthly_cube(spark, sf_dir), domain).table(), "thetao", "so")

    _query(name, f"with {_MON} select {_CELL}, {_VALUES} from cube where {condition}")(run)


_TRIANGLE = ((29.8, 41.7), (32.3, 43.2), (30.4, 45.4))
_SQUARE = ((31.2, 43.6), (32.2, 43.6), (32.2, 45.2), (31.2, 45.2))


def _even_odd(ring: tuple[tuple[float, float], ...]) -> str:
    edges = [(*a, *b) for a, b in zip(ring, (*ring[1:], ring[0])) if a[1] != b[1]]
    d = "{}::double".format
    hits = [f"(case when ({d(y1)} > latitude) <> ({d(y2)} > latitude) and longitude < ({d(x2)} - {d(x1)}) * (latitude - {d(y1)}) / ({d(y2)} - {d(y1)}) + {d(x1)} then 1 else 0 end)" for x1, y1, x2, y2 in edges]
    return f"(({' + '.join(hits)}) % 2 = 1)"


_domain("domain_rect", RectangularDomain("box", (42.5, 44.0), (30.5, 31.5)), "latitude between 42.5 and 44 and longitude between 30.5 and 31.5")
_domain("domain_polygon", PolygonalDomain("triangle", _TRIANGLE), _even_odd(_TRIANGLE))
_domain("domain_multipolygon", MultiPolygonalDomain("both", (PolygonalDomain("triangle", _TRIANGLE), PolygonalDomain("square", _SQUARE))), f"{_even_odd(_TRIANGLE)} or {_even_odd(_SQUARE)}")


def _coast(n: int) -> tuple[tuple[float, float], ...]:
    """A ring of 2 n vertices: a ragged southern coast from west to east, and a northern one back."""
    south = [(29.7 + 2.0 * i / n, 41.6 + (i * 7919) % 101 / 60) for i in range(n)]
    north = [(29.7 + 2.0 * i / n, 44.2 + (i * 6007) % 89 / 60) for i in range(n)]
    return (*south, *reversed(north))


_COAST = 1500
_domain(
    "domain_coast", PolygonalDomain("coast", _coast(_COAST)),
    f"""(lat_idx, lon_idx) in (
      with p as (select i k, 29.7 + 2.0::double * i / {_COAST} x, 41.6 + (i * 7919) % 101 / 60::double y from range({_COAST}) t(i)
                 union all select {2 * _COAST - 1} - i, 29.7 + 2.0::double * i / {_COAST}, 44.2 + (i * 6007) % 89 / 60::double from range({_COAST}) t(i)),
      e as (select x x1, y y1, lead(x, 1, 29.7::double) over (order by k) x2, lead(y, 1, 41.6::double) over (order by k) y2 from p),
      c as (select distinct lat_idx, lon_idx, latitude, longitude from cube)
      select lat_idx, lon_idx from c join e on (y1 > latitude) <> (y2 > latitude) and longitude < (x2 - x1) * (latitude - y1) / (y2 - y1) + x1 group by 1, 2 having count(*) % 2 = 1)""",
)

# Corners of a ragged star around a middle, in steps that both engines compute alike.
_STAR = ((2, 0), (1, 1), (0, 3), (-1, 1), (-2, 0), (-1, -1), (0, -3), (1, -1))
_STARS = "select s_suppkey polygon, 30 + s_suppkey * 37 % 101 * 0.02::double cx, 42 + s_suppkey * 53 % 97 * 0.03::double cy, 0.1 + s_suppkey % 7 * 0.05::double r from supplier"


@_query(
    "points_in_regions",
    f"""with s as ({_STARS}), corner as (select * from (values {", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(_STAR))}) c(k, dx, dy)),
    v as (select polygon, k, cx + dx * r x, cy + dy * r y from s cross join corner),
    e as (select a.polygon, a.x x1, a.y y1, b.x x2, b.y y2 from v a join v b on a.polygon = b.polygon and b.k = (a.k + 1) % {len(_STAR)}),
    p as (select distinct 30.0::double + o_custkey % 21 * 0.1::double x, 42.0::double + o_custkey % 31 * 0.1::double y from orders)
    select round(p.x, 6) x, round(p.y, 6) y, polygon from p join e on (y1 > p.y) <> (y2 > p.y) and p.x < (x2 - x1) * (p.y - y1) / (y2 - y1) + x1 group by p.x, p.y, polygon having count(*) % 2 = 1""",
)
def points_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region for each supplier, and the places of orders that lie in it."""
    star = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.col("s_suppkey").alias("polygon"), (F.lit(30) + F.col("s_suppkey") * 37 % 101 * F.lit(0.02)).alias("cx"), (F.lit(42) + F.col("s_suppkey") * 53 % 97 * F.lit(0.03)).alias("cy"),
        (F.lit(0.1) + F.col("s_suppkey") % 7 * F.lit(0.05)).alias("r"),
    )
    ring = F.array(*[F.struct((F.col("cx") + x * F.col("r")).alias("x"), (F.col("cy") + y * F.col("r")).alias("y")) for x, y in _STAR])
    places = order_points(spark, sf_dir).select(F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    return points_in_polygons(places, star.select("polygon", ring.alias("ring"))).select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "polygon")


# a domain or a slice, then the variables, then an action

_TRI = PolygonalDomain("triangle", _TRIANGLE)
_INSIDE = f"inside as (select * from cube where {_even_odd(_TRIANGLE)}), t as (select distinct \"time\" from cube)"


@_query(
    "domain_then_monthly_climatology",
    f"""with {_MON}, {_INSIDE}, w as (select cast(month("time") as integer) "month", sum(day(last_day("time"))) nd from t group by 1),
    g as (select cast(month("time") as integer) "month", depth_idx, lat_idx, lon_idx, sum(thetao * day(last_day("time"))) total from inside group by 1, 2, 3, 4)
    select w."month", c.depth_idx, c.lat_idx, c.lon_idx, round(coalesce(g.total, 0) / w.nd, 6) thetao
    from w cross join (select distinct depth_idx, lat_idx, lon_idx from inside) c left join g on g."month" = w."month" and g.depth_idx = c.depth_idx and g.lat_idx = c.lat_idx and g.lon_idx = c.lon_idx""",
)
def domain_then_monthly_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = cut_to(monthly_cube(spark, sf_dir), _TRI).select(["thetao"])
    return _tidy(run_action("climatology", frame, variable="thetao", frequency="monthly").table(), "thetao")


@_query(
    "domain_then_stats",
    f"""with {_MON}, {_INSIDE}, one as (select * from inside where "time" <> (select min("time") from cube) or lat_idx <> 1)
    select depth_idx, lat_idx, lon_idx, case when count(so) = (select count(*) from t) then round(avg(so), 6) end so_mean, case when count(so) = (select count(*) from t) then round(median(so), 6) end so_median
    from one group by 1, 2, 3""",
)
def domain_then_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of the domain lacks the first step, which the time axis keeps."""
    frame = cut_to(monthly_cube(spark, sf_dir), _TRI).select(["so"])
    frame = frame.map(lambda t: t.where((F.col("time") != frame.first_step()) | (F.col("lat_idx") != 1)))
    return _tidy(run_action("calculate_stats", frame, operations=["mean", "median"]).table(), "so_mean", "so_median")


@_query("slice_then_depth_average", f'with {_MON} select "time", lat_idx, lon_idx, round(sum(thetao * {_CUT}) / sum({_CUT}), 6) thetao from cube where depth between 2 and 20 group by 1, 2, 3')
def slice_then_depth_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(run_action("compute_depth_average", monthly_cube(spark, sf_dir).between("depth", 2.0, 20.0).select(["thetao"])).table(), "thetao")


@_query("slice_then_area_mean", f'with {_MON} select "time", depth_idx, round(sum(thetao * area) / sum(area), 6) thetao from cube where latitude between 43 and 45 and longitude between 30.5 and 31.5 group by 1, 2')
def slice_then_area_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = monthly_cube(spark, sf_dir).between("latitude", 43.0, 45.0).between("longitude", 30.5, 31.5).select(["thetao"])
    return _tidy(run_action("reduce_axes", frame, axes=["latitude", "longitude"]).table(), "thetao")


@_query(
    "slice_then_ascii",
    f"""with {_MON}, m as (select lat_idx, lon_idx, avg(thetao) x from cube where depth_idx = 2 and latitude between 43 and 44 and longitude >= 30.5 group by 1, 2), g as (select y, x from range(1, 3) a(y) cross join range(1, 5) b(x))
    select cast(2 - g.y as integer) "row", string_agg(coalesce(printf('%.8f', m.x), '-9999'), ' ' order by g.x) line from g left join m on m.lat_idx = g.y and m.lon_idx = g.x group by g.y""",
)
def slice_then_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = monthly_cube(spark, sf_dir).between("latitude", 43.0, 44.0).between("longitude", 30.5).select(["thetao"])
    return ascii_lines(run_action("extract_layer", frame, depth=5.0))


@_query("slice_then_bottom", f"""with {_MON}, part as (select * from cube where depth >= 2 and depth <= 40), n as (select lat_idx, lon_idx, count(*) n from part where "time" = (select min("time") from cube) group by 1, 2),
    b as (select c.lat_idx, c.lon_idx, coalesce(n.n, 5) bottom from (select distinct lat_idx, lon_idx from part) c left join n using (lat_idx, lon_idx))
    select "time", lat_idx, lon_idx, {_VALUES} from part join b using (lat_idx, lon_idx) where depth_idx = bottom""")
def slice_then_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(run_action("extract_bottom", monthly_cube(spark, sf_dir).between("depth", 2.0, 40.0)).table(), "thetao", "so")


class _Cube(providers.Provider):
    """The monthly cube as a provider, with the indices of the whole grid."""

    kind = "cube"

    def __init__(self, sf_dir: str) -> None:
        self.sf_dir = sf_dir

    def available_variables(self, frequency: str) -> list[str]:
        return ["thetao", "so"] if frequency == "monthly" else []

    def read(self, spark: SparkSession, variable: str, frequency: str, start: datetime, end: datetime) -> DataFrame:
        return monthly_cube(spark, self.sf_dir).select([variable]).between("time", start, end).table()

    def describe(self) -> str:
        return "the monthly cube"


@_query(
    "ingest_box_then_volume_mean",
    f"""with {_MON} select "time", round(sum(thetao * area * {_CUT}) / sum(area * {_CUT}), 6) thetao, round(sum(so * area * {_CUT}) / sum(area * {_CUT}), 6) so from cube
    where depth between 2 and 20 and latitude between 43 and 45 and longitude between 30.5 and 31.5 and "time" between timestamp '1995-01-01' and timestamp '1996-12-31' group by 1""",
)
def ingest_box_then_volume_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection made from the cube in a box that begins at no index 0, in files by year; then reduced."""
    box = RectangularDomain("Box", (43.0, 45.0), (30.5, 31.5), (2.0, 20.0))
    folder = f"{shared_folder(spark)}/collection-{uuid.uuid4().hex}"
    made = providers.ingest(spark, folder, box, ["thetao", "so"], "monthly", datetime(1995, 1, 1), datetime(1996, 12, 31), _Cube(sf_dir), "year")
    return _tidy(run_action("reduce_axes", made.frame(spark), axes=["depth", "latitude", "longitude"]).table(), "thetao", "so")


class _TwoGrids(_Cube):
    """The monthly cube with salinity on latitudes of its own, half a degree to the north."""

    kind = "two-grids"

    def read(self, spark: SparkSession, variable: str, frequency: str, start: datetime, end: datetime) -> DataFrame:
        cells = super().read(spark, variable, frequency, start, end)
        return cells.withColumn("latitude", F.col("latitude") + 0.5) if variable == "so" else cells


@_query(
    "ingest_different_grids",
    f"""with {_MON}, part as (select * from cube where "time" between timestamp '1995-03-01' and timestamp '1995-12-31'), a as (select "time", depth_idx, latitude, lon_idx, thetao from part),
    b as (select "time", depth_idx, latitude + 0.5 latitude, lon_idx, so from part where latitude <= 44)
    select "time", depth_idx, latitude, lon_idx, {_VALUES} from a full join b using ("time", depth_idx, latitude, lon_idx)""",
)
def ingest_different_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variables on grids of their own in one collection, in files by month; read on the union of their coordinates."""
    folder = f"{shared_folder(spark)}/collection-{uuid.uuid4().hex}"
    box = RectangularDomain("Box", (42.0, 45.0), (30.0, 32.0))
    made = providers.ingest(spark, folder, box, ["thetao", "so"], "monthly", datetime(1995, 3, 1), datetime(1995, 12, 31), _TwoGrids(sf_dir), "month")
    return _tidy(made.frame(spark).table().drop("lat_idx"), "thetao", "so", drop=("depth", "longitude"))


@_query(
    "ingest_polygon_then_mean",
    f"""with {_MON}, {_INSIDE} select "time", depth_idx, round(sum(thetao * area) / sum(area), 6) thetao from inside where "time" between timestamp '1995-01-01' and timestamp '1996-06-30' group by 1, 2""",
)
def ingest_polygon_then_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection of a polygon holds its box; an analysis takes the cells in the polygon, which the catalogue keeps."""
    folder = f"{shared_folder(spark)}/collection-{uuid.uuid4().hex}"
    providers.ingest(spark, folder, _TRI, ["thetao"], "monthly", datetime(1995, 1, 1), datetime(1996, 6, 30), _Cube(sf_dir), "year")
    made = collection.Collection.load(folder)
    return _tidy(run_action("reduce_axes", made.inside(made.frame(spark)), axes=["latitude", "longitude"]).table(), "thetao")


@_query(
    "collection_slice",
    f"""with {_MON} select {_CELL}, round(thetao, 6) thetao from cube where "time" between timestamp '1996-02-01' and timestamp '1996-05-15' and latitude between 43 and 44 and depth between 0 and 10""",
)
def collection_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a collection in files by month only those are read that may hold cells of the slice, by what the catalogue keeps of each."""
    folder = f"{shared_folder(spark)}/collection-{uuid.uuid4().hex}"
    box = RectangularDomain("Box", (42.0, 45.0), (30.0, 32.0))
    made = providers.ingest(spark, folder, box, ["thetao"], "monthly", datetime(1995, 1, 1), datetime(1996, 12, 31), _Cube(sf_dir), "month")
    return _tidy(made.frame(spark, ["thetao"], datetime(1996, 2, 1), datetime(1996, 5, 15), {"latitude": (43.0, 44.0), "depth": (0.0, 10.0)}).table(), "thetao")


@_query("bottom_both", f'with {_MON}, {_POINTS} select "time", lat_idx, lon_idx, {_VALUES} from cube join bottom using (lat_idx, lon_idx) where depth_idx = bottom_idx')
def bottom_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(run_action("extract_bottom", monthly_cube(spark, sf_dir)).table(), "thetao", "so")


@_query("variables_selected", f"with {_MON} select {_CELL}, round(so, 6) so from cube")
def variables_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(monthly_cube(spark, sf_dir).select(["so"]).table(), "so")


@_query("depth_slice", f"with {_MON} select {_CELL}, {_VALUES} from cube where depth >= 2 and depth <= 10")
def depth_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(monthly_cube(spark, sf_dir).between("depth", 2.0, 10.0).table(), "thetao", "so")


@_query("time_slice", f"""with {_MON} select {_CELL}, {_VALUES} from cube where "time" between timestamp '1997-03-01' and timestamp '1997-08-15'""")
def time_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(monthly_cube(spark, sf_dir).between("time", datetime(1997, 3, 1), datetime(1997, 8, 15)).table(), "thetao", "so")


@_query("first_time_step", f'with {_MON} select {_CELL}, {_VALUES} from cube where "time" = (select min("time") from cube)')
def first_time_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(first_time(monthly_cube(spark, sf_dir)).table(), "thetao", "so")


@_query(
    "nearest_time_step",
    f"""with {_MON} select {_CELL}, {_VALUES} from cube where "time" = (select "time" from (select distinct "time" from cube) order by abs(epoch_us("time") - epoch_us(timestamp '1998-03-20')), "time" desc limit 1)""",
)
def nearest_time_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(nearest_time(monthly_cube(spark, sf_dir), datetime(1998, 3, 20)).table(), "thetao", "so")


@_query(
    "align_outer",
    f"with {_MON}, a as (select {_CELL}, thetao from cube where (depth_idx + lat_idx) % 3 <> 0), b as (select {_CELL}, so from cube where (depth_idx + lon_idx) % 4 <> 0) select {_CELL}, {_VALUES} from a full join b using ({_CELL})",
)
def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = monthly_cube(spark, sf_dir)
    a = frame.select(["thetao"]).table().where("(depth_idx + lat_idx) % 3 != 0")
    b = frame.select(["so"]).table().where("(depth_idx + lon_idx) % 4 != 0")
    return _tidy(align_outer([a, b]), "thetao", "so")


@_query(
    "align_different_grids",
    f"""with {_MON}, a as (select "time", depth_idx, latitude, lon_idx, thetao from cube where (depth_idx + lat_idx) % 3 <> 0), b as (select "time", depth_idx, 42 + lat_idx * 0.5::double latitude, lon_idx, so from cube where lat_idx < 3)
    select "time", depth_idx, latitude, lon_idx, {_VALUES} from a full join b using ("time", depth_idx, latitude, lon_idx)""",
)
def align_different_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Salinity on a grid of half the spacing in latitude, whose index 1 is 42.5 and not 43."""
    frame = monthly_cube(spark, sf_dir)
    a = frame.select(["thetao"]).map(lambda t: t.where("(depth_idx + lat_idx) % 3 != 0"))
    half = {i: 42 + i * 0.5 for i in range(3)}
    b = frame.select(["so"]).map(lambda t: t.where("lat_idx < 3").withColumn("latitude", F.lit(42.0) + F.col("lat_idx") * 0.5))
    b = replace(b, axes=b.axes | {"latitude": half}, grid=b.grid | {"latitude": half})
    return _tidy(align_frames([a, b]).table().drop("lat_idx"), "thetao", "so", drop=("depth", "longitude"))


@_query("timeseries_mean", f'with {_MON} select "time", depth_idx, round(avg(thetao), 9) thetao from cube group by 1, 2')
def timeseries_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(timeseries(monthly_cube(spark, sf_dir), "thetao"), "thetao", digits=9)


@_query("timeseries_daily_1997", f"""with {_DAY} select "time", round(avg(chl), 6) chl from days where "time" between timestamp '1997-01-01' and timestamp '1997-12-31' group by 1""")
def timeseries_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(timeseries(daily_cube(spark, sf_dir), "chl", datetime(1997, 1, 1), datetime(1997, 12, 31)), "chl")


def _map(how: str) -> None:
    sql = f"""with {_MON}, t as (select "time" from (select distinct "time" from cube) order by abs(epoch_us("time") - epoch_us(timestamp '1998-03-20')), "time" desc limit 1)
    select lat_idx, lon_idx, round({'avg' if how == 'mean' else how}(thetao), 6) thetao from cube where "time" = (select "time" from t) group by 1, 2"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _tidy(map_at(monthly_cube(spark, sf_dir), "thetao", datetime(1998, 3, 20), "depth", how), "thetao")

    _query(f"map_nearest_time_{how}", sql)(run)


for _how in ("mean", "max", "min"):
    _map(_how)


@_query("raster_time_mean", f"with {_MON} select lat_idx, lon_idx, round(avg(thetao), 6) thetao from cube where depth_idx = 0 group by 1, 2")
def raster_time_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(raster(run_action("extract_surface", monthly_cube(spark, sf_dir).select(["thetao"]))), "thetao")


@_query(
    "ascii_grid",
    f"""with {_MON}, m as (select lat_idx, lon_idx, avg(thetao) x from cube where depth_idx = 4 group by 1, 2), g as (select y, x from range(4) a(y) cross join range(5) b(x))
    select cast(3 - g.y as integer) "row", string_agg(coalesce(printf('%.8f', m.x), '-9999'), ' ' order by g.x) line from g left join m on m.lat_idx = g.y and m.lon_idx = g.x group by g.y""",
)
def ascii_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ascii_lines(run_action("extract_layer", monthly_cube(spark, sf_dir).select(["thetao"]), depth=20.0))


@_query(
    "ascii_grid_compat",
    f"""with {_MON}, m as (select lat_idx, lon_idx, avg(thetao) x from cube where depth_idx = 4 group by 1, 2), g as (select y, x from range(4) a(y) cross join range(5) b(x))
    select cast(g.y as integer) "row", string_agg(coalesce(printf('%.8f', m.x), '-9999'), ' ' order by g.x) line from g left join m on m.lat_idx = g.y and m.lon_idx = g.x group by g.y""",
)
def ascii_grid_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ascii_lines(run_action("extract_layer", monthly_cube(spark, sf_dir).select(["thetao"]), depth=20.0), north_first=False)


@_query(
    "netcdf_round_trip",
    f"""with {_MON} select {_CELL}, latitude, {_VALUES} from cube where "time" between timestamp '1995-04-01' and timestamp '1996-03-31' and depth between 1 and 20 and latitude >= 43""",
)
def netcdf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both variables in one file, and what is read of it by ranges of its axes."""
    path = f"{shared_folder(spark)}/cube-{uuid.uuid4().hex}.nc"
    write_netcdf(monthly_cube(spark, sf_dir), path)
    between = {"time": (datetime(1995, 4, 1), datetime(1996, 3, 31)), "depth": (1.0, 20.0), "latitude": (43.0, None)}
    both = align_outer([gridfiles.read_grid(spark, path, v, between=between) for v in ("thetao", "so")])
    return _tidy(both, "thetao", "so", drop=("depth", "longitude"))


@_query("geotiff_round_trip", f"with {_MON} select cast(3 - lat_idx as integer) \"row\", lon_idx, latitude, longitude, round(avg(thetao), 6) thetao from cube where depth_idx = 2 group by 1, 2, 3, 4")
def geotiff_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/layer-{uuid.uuid4().hex}.tif"
    write_geotiff(run_action("extract_layer", monthly_cube(spark, sf_dir).select(["thetao"]), depth=5.0), path)
    return _tidy(read_geotiff(spark, path, "thetao").table().withColumnRenamed("lat_idx", "row"), "thetao", drop=())


@_query("ascii_file", f"""with {_MON}, m as (select lat_idx, lon_idx, avg(so) x from cube where depth_idx = 0 group by 1, 2), g as (select y, x from range(4) a(y) cross join range(5) b(x)),
    line as (select 3 - g.y k, string_agg(coalesce(printf('%.8f', m.x), '-9999'), ' ' order by g.x) line from g left join m on m.lat_idx = g.y and m.lon_idx = g.x group by g.y)
    select line from line union all select unnest(['ncols 5', 'nrows 4', 'xllcorner 29.62500000', 'yllcorner 41.62500000', 'cellsize 0.75000000', 'NODATA_value -9999'])""")
def ascii_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a whole file, as tasks wrote it."""
    path = f"{shared_folder(spark)}/surface-{uuid.uuid4().hex}.asc"
    write_ascii(run_action("extract_surface", monthly_cube(spark, sf_dir).select(["so"])), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


_MESH = """
e1 as (select cast(p_partkey // 5 % 4 as integer) lat_idx, cast(p_partkey % 5 as integer) lon_idx, avg(p_size) + 1 e1t, avg(p_retailprice) e2t from part group by 1, 2),
e3 as (select cast(l_linenumber - 1 as integer) depth_idx, cast(l_suppkey % 4 as integer) lat_idx, cast(l_partkey % 5 as integer) lon_idx, avg(l_quantity) e3t from lineitem group by 1, 2, 3)"""


def _mesh(spark: SparkSession, sf_dir: str) -> mesh.Mesh:
    """Sizes of cells from parts and line items, by way of a mesh mask's file."""
    part, li = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem"))
    grid = {"depth": DEPTHS, "latitude": LATITUDES, "longitude": LONGITUDES}
    flat = part.groupBy((F.floor(F.col("p_partkey") / 5) % 4).cast("int").alias("lat_idx"), (F.col("p_partkey") % 5).cast("int").alias("lon_idx")).agg((F.avg("p_size") + 1).alias("e1t"), F.avg("p_retailprice").alias("e2t"))
    deep = li.groupBy((F.col("l_linenumber") - 1).cast("int").alias("depth_idx"), (F.col("l_suppkey") % 4).cast("int").alias("lat_idx"), (F.col("l_partkey") % 5).cast("int").alias("lon_idx")).agg(F.avg("l_quantity").alias("e3t"))
    placed = lambda t: t.withColumns({a: at_index(grid[a], F.col(COLUMNS[a][0])) for a in grid if COLUMNS[a][0] in t.columns})
    path = f"{shared_folder(spark)}/mesh-{uuid.uuid4().hex}.nc"
    write_netcdf(GridFrame((placed(flat), placed(deep)), grid), path)
    return mesh.read_mesh(spark, path)


@_query("mesh_volume_mean", f'with {_MON}, {_MESH} select "time", round(sum(thetao * e1t * e2t * e3t) / sum(e1t * e2t * e3t), 6) thetao from cube join e1 using (lat_idx, lon_idx) join e3 using (depth_idx, lat_idx, lon_idx) group by 1')
def mesh_volume_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = monthly_cube(spark, sf_dir).select(["thetao"])
    return _tidy(mesh.reduce_by_mesh(frame, _mesh(spark, sf_dir), ["depth", "latitude", "longitude"]).table(), "thetao")


@_query("mesh_depth_integral", f'with {_MON}, {_MESH} select "time", lat_idx, lon_idx, round(sum(so * e3t) / 1e3, 6) so from cube join e3 using (depth_idx, lat_idx, lon_idx) group by 1, 2, 3')
def mesh_depth_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = monthly_cube(spark, sf_dir).select(["so"])
    out = mesh.reduce_by_mesh(frame, _mesh(spark, sf_dir), ["depth"], "integral").table()
    return _tidy(out.withColumn("so", F.col("so") / 1e3), "so")


@_query("csv_rows", f'with {_MON} select "time", latitude, longitude, round(thetao, 6) thetao from cube where depth_idx = 0')
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tidy(csv_table(run_action("extract_surface", monthly_cube(spark, sf_dir).select(["thetao"]))), "thetao", drop=())


@_query("nearest_wet_point", f"with {_MON}, {_POINTS} select pid, lat_idx, lon_idx, distance from near")
def nearest_wet_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = monthly_cube(spark, sf_dir).select(["thetao"])
    water = water_mask(frame).select("lat_idx", "lon_idx", "latitude", "longitude").distinct()
    return nearest_water(order_points(spark, sf_dir), water).select("pid", "lat_idx", "lon_idx", "distance")


_SERIES = f"""with {_MON}, {_POINTS}, series as (select n.pid, n.distance, c."time" model_time, c.depth model_depth, c.thetao from near n join bottom b using (lat_idx, lon_idx)
    left join cube c on c.lat_idx = n.lat_idx and c.lon_idx = n.lon_idx and c.depth_idx = b.bottom_idx and c."time" between n."time" - interval 90 day and n."time" + interval 1 millisecond)"""


@_query("bottom_series", f"{_SERIES} select pid, distance, model_time, model_depth, round(thetao, 6) thetao from series")
def bottom_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = BottomCellMap(monthly_cube(spark, sf_dir).select(["thetao"]), timedelta(days=90)).series(order_points(spark, sf_dir))
    return _tidy(found.select("pid", "distance", "model_time", "model_depth", "thetao"), "thetao")


def _summary(series: pd.DataFrame) -> dict:
    return {"steps": len(series), "mean": float(series["thetao"].mean()) if len(series) else None, "last": float(series["thetao"].iloc[-1]) if len(series) else None}


@_query("bottom_cell_map", f"{_SERIES} select pid, cast(count(model_time) as bigint) steps, round(avg(thetao), 6) mean, round(arg_max(thetao, model_time), 6) last from series group by pid")
def bottom_cell_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = order_points(spark, sf_dir)
    out = BottomCellMap(monthly_cube(spark, sf_dir).select(["thetao"]), timedelta(days=90)).map(_summary, points, "steps long, mean double, last double")
    return _tidy(out.select("pid", "steps", "mean", "last"), "mean", "last")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.groupBy("o_custkey").agg(F.min("o_orderdate").cast("timestamp_ntz").alias("start"), F.max("o_orderdate").cast("timestamp_ntz").alias("end"))


def _split(by: str) -> None:
    sql = f"""with s as (select o_custkey, cast(min(o_orderdate) as timestamp) a, cast(max(o_orderdate) as timestamp) b from orders group by 1),
    cuts as (select o_custkey, a c, b from s where a < b union all
             select o_custkey, c, b from (select o_custkey, b, unnest(generate_series(cast(date_trunc('{by}', a) + interval 1 {by} as timestamp), b, interval 1 {by})) c from s where a < b) where c < b)
    select o_custkey, c part_start, coalesce(lead(c) over (partition by o_custkey order by c) - interval 1 second, b) part_end from cuts"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return calendar.split_intervals(_spans(spark, sf_dir), by).select("o_custkey", "part_start", "part_end")

    _query(f"split_by_{by}", sql)(run)


_split("month")
_split("year")


@_query(
    "n_time_steps",
    """with s as (select o_custkey, min(o_orderdate) a, max(o_orderdate) b from orders group by 1)
    select o_custkey, cast(date_diff('day', cast(a as date), cast(b as date)) + 1 as integer) daily, cast((year(b) - year(a)) * 12 + month(b) - month(a) + 1 as integer) monthly from s""",
)
def n_time_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = {f: calendar.n_time_steps(F.col("start"), F.col("end"), f) for f in ("daily", "monthly")}
    return _spans(spark, sf_dir).select("o_custkey", *[c.cast("int").alias(f) for f, c in count.items()])


@_query(
    "file_names",
    """with s as (select o_custkey, min(o_orderdate) a, max(o_orderdate) b from orders group by 1)
    select o_custkey, 'Adriatic_thetao_daily_' || strftime(a, '%Y-%m-%d') || '--' || strftime(b, '%Y-%m-%d') || '.nc' name, 'Adriatic' "domain", 'thetao' variable, 'daily' frequency, cast(a as date) "start", cast(b as date) "end" from s""",
)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = filenames.data_file_name_column(F.lit("Adriatic"), F.lit("thetao"), F.lit("daily"), F.col("start"), F.col("end"))
    named = _spans(spark, sf_dir).select("o_custkey", name.alias("name"))
    return named.select("o_custkey", "name", *filenames.data_file_parts(F.col("name")))


@_query(
    "resume_missing",
    """with m as (select distinct strftime(o_orderdate, '%Y-%m') m from orders), w as (select v, 'Adriatic_' || v || '_monthly_' || m || '-01--' || m || '-01.nc' name, m from m cross join (values ('thetao'), ('so')) x(v)),
    there as (select distinct 'Adriatic_thetao_monthly_' || strftime(l_shipdate, '%Y-%m') || '-01--' || strftime(l_shipdate, '%Y-%m') || '-01.nc' name from lineitem where l_suppkey % 97 = 3 and l_linenumber = 7)
    select v variable, name from w where name not in (select name from there)""",
)
def resume_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = lambda c: calendar.month_start(F.col(c))
    name = lambda v, t: filenames.data_file_name_column(F.lit("Adriatic"), v, F.lit("monthly"), t, t)
    months = spark.read.parquet(f"{sf_dir}/orders.parquet").select(month("o_orderdate").alias("m")).distinct()
    wanted = months.select("m", F.explode(F.array(F.lit("thetao"), F.lit("so"))).alias("variable")).withColumn("name", name(F.col("variable"), F.col("m")))
    there = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_suppkey % 97 = 3 and l_linenumber = 7").select(name(F.lit("thetao"), month("l_shipdate")).alias("name")).distinct()
    return collection.missing_files(wanted, there).select("variable", "name")


@_query("validate", f"with {_MON} select (min(depth) >= 0 and max(depth) <= 100) ok, case when min(depth) >= 0 and max(depth) <= 100 then '' else 'depths from ' || min(depth) || ' to ' || max(depth) end reason from cube")
def validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collection.validate(monthly_cube(spark, sf_dir).table(), "thetao", (0.0, 100.0))


@_query("layer_heights", f"with {_MON} select distinct depth_idx idx, depth, h height from cube")
def layer_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the depths at which the cube has cells."""
    levels = monthly_cube(spark, sf_dir).table().select(F.col("depth_idx").alias("idx"), "depth").distinct()
    return layer_heights_table(levels)


@_query(
    "variables",
    f"""with {_MON}, {_DAY}, n as (select 'thetao' name, count(thetao) cells from cube union all select 'so', count(so) from cube union all select 'chl', count(chl) from days)
    select v.*, coalesce(n.cells, 0) cells from (values {", ".join("('{}', '{}', '{}')".format(*v) for v in KNOWN)}) v(name, label, cmap) left join n using (name)""",
)
def known_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known variables, and the number of cells of each in the cubes."""
    frames = [monthly_cube(spark, sf_dir).table(), daily_cube(spark, sf_dir).table()]
    counts = [t.agg(*[F.count(v).alias(v) for v in GridFrame.variables_of(t)]).unpivot([], GridFrame.variables_of(t), "name", "cells") for t in frames]
    return variables_table(spark).join(counts[0].union(counts[1]), "name", "left").withColumn("cells", F.coalesce("cells", F.lit(0)).cast("long"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
