"""A user's function on the recent series of the bottom cell nearest to each point."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import GridFrame
from ..functions.geo import RADIUS, haversine
from ..lineage import settled
from .extract import bottom_index

def _place(latitude: Column, longitude: Column) -> list[Column]:
    """The point on the unit sphere: no date line and no poles, where degrees have theirs."""
    y, x = F.radians(latitude), F.radians(longitude)
    return [F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)]


def nearest_water(points: DataFrame, water: DataFrame, latitude: str = "latitude", longitude: str = "longitude", tile: float | None = None) -> DataFrame:
    """pid, lat_idx, lon_idx, model_latitude, model_longitude, distance of the water cell nearest to each point.

    ``points``: pid and coordinates in degrees; ``water``: lat_idx, lon_idx, latitude, longitude of all water cells. Distances are
    along the sphere, rounded to millimetres; ties go to the smaller lat_idx, then lon_idx. Points and cells meet on cubes of space that the sphere passes
    through, whose edge is about ``tile`` degrees (two cells of the grid, if None): the date line and the poles are places as any others. A point whose nearest cell in its own cube and those
    around is farther than an edge could have a nearer one, and is tried again with edges twice as long, until a cube holds the sphere. Points
    without coordinates are left out; without water there are no rows. Points that share coordinates are searched once."""
    named = points.select("pid", F.col(latitude).alias("_y"), F.col(longitude).alias("_x")).where("_y is not null and _x is not null")
    cells = water.select("lat_idx", "lon_idx", F.col("latitude").alias("model_latitude"), F.col("longitude").alias("model_longitude"))
    cells = settled(cells.withColumns(dict(zip(("_a", "_b", "_c"), _place(F.col("model_latitude"), F.col("model_longitude"))))))
    todo = named.select("_y", "_x").distinct()
    todo = todo.withColumns(dict(zip(("_a", "_b", "_c"), _place(F.col("_y"), F.col("_x")))))
    found: DataFrame | None = None
    edge = math.radians(_two_cells(cells) if tile is None else tile)
    keys = ("_i", "_j", "_k")
    while True:
        last = edge >= 2
        cube = lambda c: F.floor(F.col(c) / F.lit(edge)).cast("int")  # noqa: E731, B023
        shift = F.explode(F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip(by, "ijk")]) for by in itertools.product((-1, 0, 1), repeat=3)]))
        near = cells.withColumn("_s", shift).select("lat_idx", "lon_idx", "model_latitude", "model_longitude", *[(cube(c) + F.col(f"_s.{n}")).alias(k) for c, n, k in zip(("_a", "_b", "_c"), "ijk", keys)])
        asked = todo.select("_y", "_x", *[cube(c).alias(k) for c, k in zip(("_a", "_b", "_c"), keys)])
        distance = F.round(haversine(F.col("_y"), F.col("_x"), F.col("model_latitude"), F.col("model_longitude")), 3)
        best = asked.join(near, list(keys)).groupBy("_y", "_x").agg(F.min(F.struct(distance.alias("distance"), "lat_idx", "lon_idx", "model_latitude", "model_longitude")).alias("b"))
        # whatever is not in these cubes is farther than a chord as long as an edge
        sure = F.lit(True) if last else F.coalesce(F.col("b.distance") <= 2 * RADIUS * math.asin(edge / 2) * (1 - 1e-9) - 0.001, F.lit(False))
        state = settled(todo.join(best, ["_y", "_x"], "left").withColumn("sure", sure))
        done = state.where("sure and b is not null").select("_y", "_x", "b.*")
        found = done if found is None else found.union(done)
        todo = state.where("not sure").select("_y", "_x", "_a", "_b", "_c")
        if last or todo.isEmpty():
            break
        edge *= 2
    return named.join(found, ["_y", "_x"]).select("pid", "lat_idx", "lon_idx", "model_latitude", "model_longitude", "distance")


def _two_cells(cells: DataFrame) -> float:
    """Twice the mean spacing of the grid in degrees, the larger of both directions; 1 where there is one cell or none."""
    ends = cells.agg(*[f(c) for c in ("lat_idx", "lon_idx", "model_latitude", "model_longitude") for f in (F.min, F.max)]).first()
    steps = [(ends[k + 1] - ends[k]) / (ends[i + 1] - ends[i]) for i, k in ((0, 4), (2, 6)) if ends[i] is not None and ends[i + 1] > ends[i]]
    return min(60.0, max(2 * max(abs(s) for s in steps), 1e-3)) if steps else 1.0


class BottomCellMap:
    """Maps a function over points, each with the series of a variable set in the bottom cell nearest to it.

    ``frame``: variables of time, depth, latitude and longitude, or without depth; ``variable`` tells water and bottom."""

    def __init__(self, frame: GridFrame, time_range: timedelta, lat_column: str = "latitude", lon_column: str = "longitude", time_column: str = "time", variable: str | None = None) -> None:
        self.frame, self.time_range = frame, time_range
        self.lat, self.lon, self.time = lat_column, lon_column, time_column
        self.variable = variable or frame.variables[0]

    def series(self, points: DataFrame, tile: float | None = None) -> DataFrame:
        """Every step of each point's cell from ``time_range`` before the point's time to a millisecond after it.

        ``points`` have pid, unique. Columns: those of ``points``, model_time, model_latitude, model_longitude, model_depth,
        distance, and the variables; a point without steps has one row with null model_time. The join is on the cell's
        indices and on buckets of time as long as the interval, of which a point asks two, so that its work goes with the steps that are found, also where many points share a cell."""
        t = self.frame.table_of(self.variable)
        cells = t.select("lat_idx", "lon_idx", "latitude", "longitude").distinct()
        deep = "depth_idx" in t.columns
        if deep:
            first = t.where(F.col("time") == self.frame.first_step()) if "time" in t.columns else t
            wet = first.where(F.col(self.variable).isNotNull()).select("lat_idx", "lon_idx").distinct()
            cells = cells.join(wet, ["lat_idx", "lon_idx"], "left_semi")
        at = points.join(nearest_water(points, cells, self.lat, self.lon, tile), "pid", "left")
        own = t.select(*[c for c in t.columns if c not in ("latitude", "longitude")]).withColumnRenamed("time", "model_time")
        if deep:
            at = at.join(bottom_index(self.frame, self.variable).withColumnRenamed("bottom_idx", "depth_idx"), ["lat_idx", "lon_idx"], "left")
            own = own.withColumnRenamed("depth", "model_depth")
        keys = ["lat_idx", "lon_idx", *(["depth_idx"] if deep else [])]
        at = settled(at)
        reach, later = F.lit(self.time_range), F.lit(timedelta(milliseconds=1))
        width = max(1, (self.time_range + timedelta(milliseconds=1)) // timedelta(microseconds=1))
        bucket = lambda time: F.floor(F.unix_micros(time.cast("timestamp")) / F.lit(width)).cast("long")
        when = F.col(self.time)
        asked = at.withColumn("_buckets", F.sequence(bucket(when - reach), bucket(when + later)))
        a = asked.withColumn("_bucket", F.explode_outer("_buckets")).alias("a")
        b = own.withColumn("_bucket", bucket(F.col("model_time"))).alias("b")
        when = F.col(f"a.{self.time}")
        on = (F.col("b.model_time") >= when - reach) & (F.col("b.model_time") <= when + later)
        for k in [*keys, "_bucket"]:
            on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
        values = [c for c in own.columns if c not in keys]
        met = a.join(b, on).select(*[f"a.{c}" for c in at.columns], *[f"b.{c}" for c in values])
        # points that no step meets in any of their buckets
        lone = a.join(b, on, "left_anti").groupBy("a.pid").agg(F.count(F.lit(1)).alias("n"), F.first(F.size("_buckets")).alias("asked")).where("n >= coalesce(asked, 1)")
        none = at.join(lone.select("pid"), "pid", "left_semi").select(*at.columns, *[F.lit(None).cast(dict(own.dtypes)[c]).alias(c) for c in values])
        return met.union(none).drop(*keys)

    def map(self, func: Callable[[pd.DataFrame], dict], points: DataFrame, schema: str | None = None, tile: float | None = None) -> DataFrame:
        """``points`` (pid, unique and not null) with the columns that ``func`` returns for each, as a dict of the fields of ``schema``.

        ``func`` gets the point's series ordered by model_time (empty where no step lies in the range), with the point's own
        columns on every row. It runs in pandas, once for each point; its input is one cell's steps in ``time_range``. Without a
        ``schema`` it is inferred by a run of ``func`` on the first point with steps (else on an empty series): integers as long, floats as double.
        """
        if schema is None:
            schema = self._inferred(func, points, tile)
        names = [x.strip().split(" ")[0] for x in schema.split(",")]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Rows come sorted by point: whole points of each batch at once, its last one with the next batch."""
            rest = None

            def mapped(pdf: pd.DataFrame) -> pd.DataFrame:
                pid = pdf["pid"].to_numpy()
                cuts = [0, *(np.flatnonzero(pid[1:] != pid[:-1]) + 1), len(pid)]
                known = pdf["model_time"].notna().to_numpy()
                rows = []
                for a, b in zip(cuts, cuts[1:]):
                    made = func(pdf.iloc[a:b] if known[a] else pdf.iloc[a:a])
                    rows.append((pid[a], *(made[n] for n in names)))
                return pd.DataFrame(rows, columns=["pid", *names])

            for pdf in batches:
                pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
                if not len(pdf):
                    continue
                last = int((pdf["pid"] == pdf["pid"].iloc[-1]).to_numpy().argmax())
                rest = pdf.iloc[last:]
                if last:
                    yield mapped(pdf.iloc[:last])
            if rest is not None:
                yield mapped(rest)

        rows = self.series(points, tile).repartition("pid").sortWithinPartitions("pid", "model_time")
        return points.join(rows.mapInPandas(run, f"pid {dict(points.dtypes)['pid']}, {schema}"), "pid", "left")

    def _inferred(self, func: Callable[[pd.DataFrame], dict], points: DataFrame, tile: float | None) -> str:
        """The schema of what ``func`` returns, from one point: the smallest pid that has steps."""
        rows = self.series(points, tile)
        first = rows.where("model_time is not null").agg(F.min("pid")).first()[0]
        one = rows.where(F.col("pid") == F.lit(first)).orderBy("model_time") if first is not None else rows.where("false")
        made = func(one.toPandas())

        def kind(x: object) -> str:
            if isinstance(x, (bool, np.bool_)):
                return "boolean"
            if isinstance(x, (int, np.integer)):
                return "long"
            if isinstance(x, (pd.Timestamp, datetime)):
                return "timestamp_ntz"
            return "string" if isinstance(x, str) else "double"

        return ", ".join(f"{k} {kind(v)}" for k, v in made.items())
