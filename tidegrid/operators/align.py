"""Putting variables and files together on common coordinates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import COLUMNS, GridFrame, at_index

#: How far coordinates of one place may lie apart, as a share of them (of 1 at least): more than single precision rounds.
TOLERANCE = 1e-6

Axis = dict[int, float]
Grid = dict[str, Axis]


def _same(a: float, b: float, tolerance: float) -> bool:
    return abs(a - b) <= tolerance * max(1.0, abs(a), abs(b))


def along_time(parts: Sequence[DataFrame]) -> DataFrame:
    """Files of one variable for different times, one after the other."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def one_numbering(axes: Sequence[Axis], tolerance: float = TOLERANCE) -> Axis | None:
    """All values by index, if the axes are pieces of one axis: no index has two values, and values rise or fall with the index. Else None."""
    out: Axis = {}
    for axis in axes:
        for i, x in axis.items():
            if not _same(out.setdefault(i, x), x, tolerance):
                return None
    values = [out[i] for i in sorted(out)]
    steps = [b - a for a, b in zip(values, values[1:])]
    whole = all(s > 0 for s in steps) or all(s < 0 for s in steps)
    return dict(sorted(out.items())) if whole and not any(_same(a, b, tolerance) for a, b in zip(values, values[1:])) else None


def union_axis(axes: Sequence[Axis], tolerance: float = TOLERANCE) -> tuple[Axis, list[dict[int, int]]]:
    """The sorted union of axes, numbered from 0, and for each axis its indices in the union.

    Values within ``tolerance`` of the smallest of theirs are one place, which is called as in the first axis that has it. The union falls if all axes do. Two values of
    one axis at the same place are a ValueError."""
    falling = all(len(a) < 2 or a[min(a)] > a[max(a)] for a in axes) and any(len(a) > 1 for a in axes)
    found = sorted((x, k, i) for k, axis in enumerate(axes) for i, x in axis.items())
    places: list[list[tuple[float, int, int]]] = []
    for x, k, i in found:
        if places and _same(places[-1][0][0], x, tolerance):
            if any(of == k for _, of, _ in places[-1]):
                raise ValueError(f"values of one axis lie within the tolerance: {places[-1][0][0]} and {x}")
            places[-1].append((x, k, i))
        else:
            places.append([(x, k, i)])
    if falling:
        places.reverse()
    remaps: list[dict[int, int]] = [{} for _ in axes]
    values: Axis = {}
    for new, members in enumerate(places):
        values[new] = min(members, key=lambda m: m[1])[0]
        for _, k, i in members:
            remaps[k][i] = new
    return values, remaps


def reconciled(grids: Sequence[Grid], tolerance: float = TOLERANCE) -> tuple[Grid, list[dict[str, dict[int, int]]]]:
    """One grid for all, and for each grid the new indices of those axes that are numbered anew.

    An axis whose pieces go together by their indices keeps these; else it is the union of coordinates (see :func:`union_axis`)."""
    out: Grid = {}
    remaps: list[dict[str, dict[int, int]]] = [{} for _ in grids]
    for axis in dict.fromkeys(a for g in grids for a in g):
        having = [k for k, g in enumerate(grids) if axis in g]
        own = [grids[k][axis] for k in having]
        whole = one_numbering(own, tolerance)
        if whole is not None:
            out[axis] = whole
            continue
        out[axis], new = union_axis(own, tolerance)
        for k, remap in zip(having, new):
            remaps[k][axis] = remap
    return out, remaps


def reindexed(table: DataFrame, grid: Grid, remaps: dict[str, dict[int, int]]) -> DataFrame:
    """``table`` with the indices and coordinates of ``grid``: old indices are looked up in array literals, so that no join is needed."""
    for axis, remap in remaps.items():
        index, value = COLUMNS[axis]
        if index in table.columns:
            table = table.withColumn(index, at_index({i: float(n) for i, n in remap.items()}, F.col(index)).cast("int"))
            table = table.withColumn(value, at_index(grid[axis], F.col(index)))
    return table


def align_outer(tables: Sequence[DataFrame], tolerance: float = TOLERANCE) -> DataFrame:
    """Variables of the same dimensions side by side: all cells that any of them has, null where one has none.

    Joined on time and the integer indices, never on coordinates of floating point; these come from whichever table has
    the cell. Tables of different dimensions are a ValueError; a cell whose coordinates differ between tables stops the query, as they are on
    different grids: see :func:`align_frames`."""
    dims = GridFrame.dims_of(tables[0])
    if any(GridFrame.dims_of(t) != dims for t in tables):
        raise ValueError("the tables have different dimensions")
    keys = [COLUMNS[d][0] for d in dims]
    values = [COLUMNS[d][-1] for d in dims if len(COLUMNS[d]) > 1]

    def one(v: str) -> Column:
        a, b = F.col(v), F.col(f"_{v}")
        apart = F.abs(a - b) > tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))
        return F.when(apart, F.raise_error(F.concat(F.lit(f"variables are on different grids: {v} "), a.cast("string"), F.lit(" and "), b.cast("string")))).otherwise(F.coalesce(a, b))

    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        joined = a.join(b.withColumnsRenamed({v: f"_{v}" for v in values}), keys, "full_outer")
        return joined.withColumns({v: one(v) for v in values}).drop(*[f"_{v}" for v in values])

    out = reduce(both, tables)
    return out.select(*[c for d in dims for c in COLUMNS[d]], *[v for t in tables for v in GridFrame.variables_of(t)])


def align_frames(frames: Sequence[GridFrame], tolerance: float = TOLERANCE) -> GridFrame:
    """Datasets on grids of their own as one on the outer union of their coordinates; variables of equal dimensions share a table.

    Grids that go together by their indices keep these. The title is that of the first, the time axis that of all."""
    grid, remaps = reconciled([f.axes for f in frames], tolerance)
    cells, _ = reconciled([f.grid for f in frames], tolerance)
    by_dims: dict[tuple[str, ...], list[DataFrame]] = {}
    for f, remap in zip(frames, remaps):
        for t in f.tables:
            by_dims.setdefault(GridFrame.dims_of(t), []).append(reindexed(t, grid, remap))
    times = [f.times.select("time") for f in frames if f.times is not None]
    own = {axis: values for axis, values in cells.items() if not any(axis in r for r in remaps)}
    merged = replace(frames[0], tables=tuple(align_outer(ts, tolerance) if len(ts) > 1 else ts[0] for ts in by_dims.values()), axes=grid, times=along_time(times) if times else None, grid=own)
    return merged


def with_mask(table: DataFrame, mask: DataFrame) -> DataFrame:
    """``table`` with tmask: whether the cell is water in ``mask`` (see extract.water_mask)."""
    keys = [COLUMNS[d][0] for d in GridFrame.dims_of(mask)]
    return table.join(mask.select(*keys, "tmask"), keys, "left").withColumn("tmask", F.coalesce("tmask", F.lit(False)))
