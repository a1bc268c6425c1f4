"""Surface, bottom and single layers; nearest times."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime
from functools import reduce as fold
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import GridFrame, nearest


def _without_depth(t: DataFrame) -> DataFrame:
    return t.drop("depth_idx", "depth")


def _no_depth_axis(frame: GridFrame, tables: list[DataFrame]) -> GridFrame:
    return replace(frame, tables=tuple(tables), axes={k: v for k, v in frame.axes.items() if k != "depth"})


def extract_surface(frame: GridFrame) -> GridFrame:
    """The first layer of the axis; variables without depth stay."""
    top = min(frame.axes.get("depth", {}), default=0)
    return _no_depth_axis(frame, [_without_depth(t.where(F.col("depth_idx") == top)) if "depth_idx" in t.columns else t for t in frame.tables])


def extract_layer(frame: GridFrame, depth: float) -> GridFrame:
    """The layer nearest to ``depth``, the deeper of two equally near; variables without depth stay."""
    if "depth" not in frame.dims:
        raise ValueError("the dataset has no depth axis")
    i = nearest(frame.axes["depth"], depth)
    return _no_depth_axis(frame, [_without_depth(t.where(F.col("depth_idx") == i)) if "depth_idx" in t.columns else t for t in frame.tables])


def bottom_index(frame: GridFrame, variable: str) -> DataFrame:
    """lat_idx, lon_idx, bottom_idx: the index of the n-th level of the axis, where n levels have data at the first time of the axis.

    Data are taken to reach from the first level without gaps. A column without data then gets the last level."""
    return bottom_indices(frame, frame.table_of(variable), [variable]).withColumnRenamed(f"_bottom_{variable}", "bottom_idx")


def bottom_indices(frame: GridFrame, t: DataFrame, variables: list[str]) -> DataFrame:
    """lat_idx, lon_idx and, for each variable of ``t``, ``_bottom_variable`` as in :func:`bottom_index`: one aggregation for all."""
    levels = list(frame.axes["depth"])
    first = F.col("time") == frame.first_step() if "time" in t.columns else F.lit(True)
    n = [F.count_if(first & F.col(v).isNotNull()).alias(f"_bottom_{v}") for v in variables]
    counted = t.groupBy("lat_idx", "lon_idx").agg(*n)
    at = F.array(*[F.lit(i) for i in levels])
    return counted.withColumns({c: F.coalesce(F.get(at, F.col(c).cast("int") - 1), F.lit(levels[-1])).cast("int") for c in (f"_bottom_{v}" for v in variables)})


def extract_bottom(frame: GridFrame) -> GridFrame:
    """Each column's deepest cell with data, by variable, as :func:`bottom_index` finds it; variables without depth stay.

    Variables of equal dimensions stay in one table, with a row where any of them has a cell stored at its bottom."""

    def change(t: DataFrame) -> DataFrame:
        if "depth_idx" not in t.columns:
            return t
        own = GridFrame.variables_of(t)
        left = [c for c in t.columns if c not in own and c not in ("depth_idx", "depth")]
        at = {v: F.col("depth_idx") == F.col(f"_bottom_{v}") for v in own}
        rows = t.join(bottom_indices(frame, t, own), ["lat_idx", "lon_idx"]).where(fold(or_, at.values()))
        if len(own) == 1:
            return rows.select(*left, *own)
        return rows.groupBy(*left).agg(*[F.max(F.when(at[v], F.col(v))).alias(v) for v in own])

    return _no_depth_axis(frame, [change(t) for t in frame.tables])


def first_time(frame: GridFrame) -> GridFrame:
    """The first step of the time axis."""
    if frame.times is None:
        return frame
    first = frame.time_axis().agg(F.min("time").alias("time"))
    return replace(frame.map(lambda t: t.where(F.col("time") == first.scalar()) if "time" in t.columns else t), times=first)


def nearest_time(frame: GridFrame, time: datetime) -> GridFrame:
    """The time step nearest to ``time``, the later of two equally near; datasets without time stay."""
    if "time" not in frame.dims:
        return frame
    at = F.lit(time).cast("timestamp_ntz")
    apart = F.abs(F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(at.cast("timestamp")))
    best = frame.time_axis().agg(F.min_by("time", F.struct(apart, -F.unix_micros(F.col("time").cast("timestamp")))).alias("time"))
    return replace(frame.map(lambda t: t.where(F.col("time") == best.scalar()) if "time" in t.columns else t), times=best)


def water_mask(frame: GridFrame) -> DataFrame:
    """Cells with data at the first time, of the first variable with depth, else of the first one: dims and tmask (true).

    Cells that are not listed are land. A dataset without a variable on latitude and longitude is a ValueError."""
    flat = [t for t in frame.tables if {"latitude", "longitude"} <= set(GridFrame.dims_of(t))]
    if not flat:
        raise ValueError("no variable has latitude and longitude")
    t = next((x for x in flat if "depth" in GridFrame.dims_of(x)), flat[0])
    v = GridFrame.variables_of(t)[0]
    if "time" in t.columns:
        t = t.where(F.col("time") == frame.first_step()).drop("time")
    return t.where(F.col(v).isNotNull()).select(*[c for c in t.columns if c not in GridFrame.variables_of(t)], F.lit(True).alias("tmask"))
