"""Weighted means and integrals, maxima and minima over any of the four axes."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import DIMS, GridFrame, at_index, keep_columns
from ..functions.geo import area_factors
from ..functions.layers import layer_heights

OPERATORS = ("mean", "integral", "max", "min")


def _first(by_index: dict[int, float], at: dict[int, float]) -> Column:
    """The value at the first index of an axis, 0 for an axis that a cut has emptied."""
    return F.lit(float(by_index[next(iter(at))]) if at else 0.0)


def weight(frame: GridFrame, axes: Sequence[str], dims: Sequence[str]) -> Column | None:
    """Weight of a cell of a table with ``dims`` when ``axes`` are reduced; None where all cells weigh the same.

    Latitude and longitude together weigh by area, whose edges are those of the whole grid; either alone weighs by the
    coordinate itself; depth by the height of the layer; time by nothing. Weights go by the index that a cell carries, so they are
    the same after any cut. A weight along a dimension that the table lacks, or that isn't reduced there, is that of the axis's first index.
    """
    parts: list[Column] = []
    if "latitude" in axes and "longitude" in axes:
        rows, columns = area_factors(frame.grid["latitude"], frame.grid["longitude"])
        parts.append(at_index(rows, F.col("lat_idx")) if "latitude" in dims else _first(rows, frame.axes["latitude"]))
        parts.append(at_index(columns, F.col("lon_idx")) if "longitude" in dims else _first(columns, frame.axes["longitude"]))
    else:
        for axis in ("latitude", "longitude"):
            if axis in axes:
                parts.append(F.col(axis).cast("double") if axis in dims else _first(frame.axes[axis], frame.axes[axis]))
    if "depth" in axes:
        depth = frame.axes["depth"]
        heights = dict(zip(depth, layer_heights(list(depth.values()))))
        parts.append(at_index(heights, F.col("depth_idx")) if "depth" in dims else _first(heights, depth))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out * p
    return out


def _reduced(table: DataFrame, over: Sequence[str], operator: str, w: Column | None, variables: Sequence[str] | None = None) -> DataFrame:
    def of(v: str) -> Column:
        x = F.col(v).cast("double")
        if operator == "max":
            return F.max(F.col(v)).alias(v)
        if operator == "min":
            return F.min(F.col(v)).alias(v)
        total = F.sum(x if w is None else x * w)
        if operator == "integral":
            return total.alias(v)
        if w is None:
            return F.avg(x).alias(v)
        return (total / F.nullif(F.sum(F.when(x.isNotNull(), w)), F.lit(0.0))).alias(v)

    return table.groupBy(*keep_columns(table, over)).agg(*[of(v) for v in variables or GridFrame.variables_of(table)])


def reduce_axes(frame: GridFrame, axes: Sequence[str], depth_min: float | None = None, depth_max: float | None = None, operator: str = "mean", operation: str | None = None) -> GridFrame:
    """Each variable reduced over those of ``axes`` that it has, in one aggregation.

    ``operator`` (or ``operation``): mean and integral are weighted (see :func:`weight`), jointly over all axes, and skip
    missing cells; max and min are not weighted. The depth range, inclusive and open where None, is cut first, and layer
    heights are those of the depths that remain, the first reaching to the surface. Variables with none of the axes stay as
    they are. A group without data gives null, and so does one whose weights sum to 0 in a mean.

    An unknown axis or operator, or a depth range without a depth axis, is a ValueError. An axis that the dataset lacks, or
    that has one value, is passed over with a UserWarning.
    """
    operator = operation or operator
    if operator not in OPERATORS:
        raise ValueError(f"the operator must be one of {', '.join(OPERATORS)}, not {operator}")
    for axis in axes:
        if axis not in DIMS:
            raise ValueError(f"{axis} is not an axis; the axes are {', '.join(DIMS)}")
    over = []
    for axis in axes:
        if axis not in frame.dims:
            warnings.warn(f"the dataset has no axis {axis}; it is ignored", UserWarning, stacklevel=2)
        elif axis != "time" and len(frame.axes.get(axis, [0, 0])) == 1:
            warnings.warn(f"the axis {axis} has one value; it is ignored", UserWarning, stacklevel=2)
        else:
            over.append(axis)
    if depth_min is not None or depth_max is not None:
        if "depth" not in frame.dims:
            raise ValueError("a depth range needs a depth axis")
        frame = frame.between("depth", depth_min, depth_max)

    def change(t: DataFrame) -> DataFrame:
        own = [a for a in over if a in GridFrame.dims_of(t)]
        if not own:
            return t
        w = weight(frame, over, own) if operator in ("mean", "integral") else None
        return _reduced(t, own, operator, w)

    left = {k: v for k, v in frame.axes.items() if k not in over}
    return replace(frame.map(change), axes=left, times=None if "time" in over else frame.times)


def compute_depth_average(frame: GridFrame, depth_min: float | None = None, depth_max: float | None = None) -> GridFrame:
    """Mean over depth, weighted by layer height."""
    return reduce_axes(frame, ["depth"], depth_min, depth_max, "mean")


def compute_depth_integral(frame: GridFrame, depth_min: float | None = None, depth_max: float | None = None) -> GridFrame:
    """Sum over depth of value times layer height."""
    return reduce_axes(frame, ["depth"], depth_min, depth_max, "integral")
