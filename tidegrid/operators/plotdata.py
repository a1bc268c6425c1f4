"""The data behind time series plots and maps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import GridFrame, keep_columns
from .extract import nearest_time

MAP_AGGREGATES = {"mean": F.avg, "max": F.max, "min": F.min}


def timeseries(frame: GridFrame, variable: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Plain mean over latitude and longitude at each time (and depth), between start and end (inclusive, each optional)."""
    t = frame.select([variable]).between("time", start, end).table_of(variable)
    return t.groupBy(*keep_columns(t, ["latitude", "longitude"])).agg(F.avg(F.col(variable).cast("double")).alias(variable))


def map_at(frame: GridFrame, variable: str, time: datetime | None = None, along: str | None = None, how: str = "mean") -> DataFrame:
    """Values on latitude and longitude: at the time step nearest to ``time``, and then mean, max or min along one more axis.

    Without ``time`` all steps stay unless ``along`` is time. What then still has other axes than latitude and longitude is a ValueError."""
    own = frame.select([variable])
    if time is not None:
        own = nearest_time(own, time)
        own = own.map(lambda t: t.drop("time") if "time" in t.columns else t)
    t = own.table_of(variable)
    if along is not None:
        if how not in MAP_AGGREGATES:
            raise ValueError(f"the aggregate must be one of {', '.join(MAP_AGGREGATES)}, not {how}")
        if along not in GridFrame.dims_of(t):
            raise ValueError(f"{variable} has no axis {along}")
        t = t.groupBy(*keep_columns(t, [along])).agg(MAP_AGGREGATES[how](F.col(variable).cast("double")).alias(variable))
    left = [d for d in GridFrame.dims_of(t) if d not in ("latitude", "longitude")]
    if left:
        raise ValueError(f"a map has latitude and longitude only; {variable} also has {', '.join(left)}")
    return t


def time_mean(table: DataFrame) -> DataFrame:
    """Mean over time of each cell, for rasters; a table without time stays."""
    if "time" not in table.columns:
        return table
    return table.groupBy(*keep_columns(table, ["time"])).agg(*[F.avg(F.col(v).cast("double")).alias(v) for v in GridFrame.variables_of(table)])
