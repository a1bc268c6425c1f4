"""The mesh mask of a model: the sizes of its cells and its water, from a NetCDF file, and reductions weighted by them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import COLUMNS, GridFrame
from ..operators.reduce import OPERATORS, _reduced
from .gridfiles import netcdf_frame

# What the variables of such a file are called.
METRICS = ("e1t", "e2t", "e3t")
MASK = "tmask"
#: Rows of a table that is sent to every task: the sizes of the axes bound them before it is read.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Mesh:
    """``axes`` of depth, latitude and longitude; ``tables``: e1t and e2t (metres from west to east and from south to north) and e3t (height), each by its indices;
    ``water``: tmask by the indices of all cells of the file that are water."""

    axes: dict[str, dict[int, float]]
    tables: dict[str, DataFrame]
    water: DataFrame | None = None

    def rows(self, dims: Sequence[str]) -> int:
        return reduce(lambda n, d: n * len(self.axes[d]), dims, 1)


def read_mesh(spark: SparkSession, path: str) -> Mesh:
    """The mesh mask at ``path``. A metric that is missing is one that reductions can't use; without any it is a ValueError."""
    axes: dict[str, dict[int, float]] = {}
    tables, water = {}, None
    for name in (*METRICS, MASK):
        try:
            f = netcdf_frame(spark, path, name)
        except ValueError as e:
            if "there is no variable" not in str(e):
                raise
            continue
        axes |= {k: v for k, v in f.axes.items() if len(v) > len(axes.get(k, {}))}
        t = f.table().drop("time", "depth", "latitude", "longitude")
        if name == MASK:
            water = t.where(f"{MASK} > 0").drop(MASK)
        else:
            tables[name] = t
    if not tables:
        raise ValueError(f"{path} has none of {', '.join(METRICS)}")
    return Mesh(axes, tables, water)


def _needed(axes: Sequence[str]) -> list[str]:
    return [m for m, axis in zip(METRICS, ("longitude", "latitude", "depth")) if axis in axes]


def with_metrics(table: DataFrame, mesh: Mesh, names: Sequence[str]) -> DataFrame:
    """``table`` with these metrics, joined by the indices that both have; cells without one have null. A metric's table goes to every task if the axes bound it
    to ``BROADCAST_ROWS``, else it is a join that Spark plans."""
    for name in names:
        if name not in mesh.tables:
            raise ValueError(f"the mesh has no {name}")
        metric = mesh.tables[name]
        dims = [d for d in ("depth", "latitude", "longitude") if COLUMNS[d][0] in metric.columns]
        keys = [COLUMNS[d][0] for d in dims]
        if lost := [k for k in keys if k not in table.columns]:
            raise ValueError(f"{name} depends on {', '.join(lost)}, which the cells lack")
        metric = metric.select(*keys, name)
        table = table.join(F.broadcast(metric) if mesh.rows(dims) <= BROADCAST_ROWS else metric, keys, "left")
    return table


def reduce_by_mesh(frame: GridFrame, mesh: Mesh, axes: Sequence[str], operator: str = "mean") -> GridFrame:
    """As reduce.reduce_axes, weighted by the sizes of the model's own cells: e1t along longitude, e2t along latitude, e3t along depth, their product along several; time isn't weighted.

    Missing cells, and cells without a size, are skipped. max and min are not weighted. An unknown axis or operator is a ValueError."""
    if operator not in OPERATORS:
        raise ValueError(f"the operator must be one of {', '.join(OPERATORS)}, not {operator}")
    if odd := [a for a in axes if a not in COLUMNS]:
        raise ValueError(f"unknown axes: {', '.join(odd)}")

    def change(t: DataFrame) -> DataFrame:
        own = [a for a in axes if a in GridFrame.dims_of(t)]
        if not own:
            return t
        names = _needed(own) if operator in ("mean", "integral") else []
        values = GridFrame.variables_of(t)
        joined = with_metrics(t, mesh, names)
        weight: Column | None = reduce(lambda a, b: a * b, [F.col(n) for n in names]) if names else None
        if weight is not None:
            joined = joined.withColumns({v: F.when(weight.isNotNull(), F.col(v)) for v in values}).withColumn("_weight", weight)
            return _reduced(joined, own, operator, F.col("_weight"), values)
        return _reduced(joined, own, operator, None, values)

    left = {k: v for k, v in frame.axes.items() if k not in axes}
    return replace(frame.map(change), axes=left, times=None if "time" in axes else frame.times)
