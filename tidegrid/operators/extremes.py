"""Smallest and largest value of each year."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import COLUMNS, GridFrame
from ..functions.calendar import year_start


def _extremes(frame: GridFrame, keep: tuple[str, ...]) -> GridFrame:
    if "time" not in frame.dims:
        raise ValueError("the dataset has no time axis")

    def change(t: DataFrame) -> DataFrame:
        own = GridFrame.variables_of(t)
        both = [f(F.col(v)).alias(f"{v}_{n}") for v in own for n, f in (("min", F.min), ("max", F.max))]
        kept = [c for d in keep if d in GridFrame.dims_of(t) for c in COLUMNS[d]]
        out = t.groupBy(F.year("time").alias("_year"), *kept).agg(*both)
        return out.select(year_start(F.col("_year")).alias("time"), *kept, *[f"{v}_{n}" for v in own for n in ("min", "max")])

    timed = replace(frame, tables=tuple(t for t in frame.tables if "time" in t.columns))
    return replace(timed.map(change), times=None, axes={k: v for k, v in frame.axes.items() if k in keep})


def extract_annual_extremes(frame: GridFrame) -> GridFrame:
    """``variable_min`` and ``variable_max`` of each year over all cells, in one aggregation; time is 1 January.

    A dataset without time is a ValueError; tables without time are left out."""
    return _extremes(frame, ())


def extract_annual_extremes_per_layer(frame: GridFrame) -> GridFrame:
    """The same for each depth."""
    return _extremes(frame, ("depth",))
