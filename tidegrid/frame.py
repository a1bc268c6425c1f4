"""A dataset on a grid as Spark tables: one table of cells for each set of dimensions, plus small axes.

Only cells with data are stored (land has no rows). A table holds ``time`` (timestamp_ntz), ``depth_idx``/``depth``,
``lat_idx``/``latitude``, ``lon_idx``/``longitude`` for the dimensions it has, and one column for each variable, null
where missing. Depth, latitude and longitude axes are lists, as in the header of a file; the time axis is a table.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = ("time", "depth", "latitude", "longitude")
COLUMNS = {"time": ("time",), "depth": ("depth_idx", "depth"), "latitude": ("lat_idx", "latitude"), "longitude": ("lon_idx", "longitude")}
#: Columns that operators add as coordinates of their results.
EXTRA = ("year", "month", "doy", "season", "tmask")
MISSING = 1e19


def _numbered(values: Sequence[float] | dict[int, float]) -> dict[int, float]:
    """Values by index, in the order of the indices."""
    return dict(sorted(values.items()) if isinstance(values, dict) else enumerate(values))


def clean(df: DataFrame, variables: Iterable[str]) -> DataFrame:
    """NaN, infinities and fill values (1e20 and the like) of the variables become null, as all operators assume."""
    return df.withColumns({v: F.when(~F.isnan(v) & (F.abs(F.col(v)) < MISSING), F.col(v)) for v in variables})


@dataclass(frozen=True)
class GridFrame:
    """``tables``: one for each set of dimensions; ``axes``: values of depth, latitude, longitude by the index that cells carry;
    ``times``: table of the ``time`` values; ``grid``: latitudes and longitudes of the whole grid; ``attrs``: attributes such as
    the title.

    An axis may be given as a list, whose indices then count from 0. A cut shortens ``axes`` and never renumbers cells;
    ``grid`` keeps the neighbours that cell edges lie between. Without ``times`` the axis is that of the tables as given
    here: cells that are cut away later stay on it, as steps without data."""

    tables: tuple[DataFrame, ...]
    axes: dict[str, dict[int, float]] = field(default_factory=dict)
    times: DataFrame | None = None
    attrs: dict[str, str] = field(default_factory=dict)
    grid: dict[str, dict[int, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        axes = {k: _numbered(v) for k, v in self.axes.items()}
        object.__setattr__(self, "axes", axes)
        grid = {k: self.grid.get(k, v) for k, v in axes.items() if k in ("latitude", "longitude")}
        object.__setattr__(self, "grid", {k: v if axes[k].items() <= v.items() else axes[k] for k, v in grid.items()})
        stored = [t.select("time") for t in self.tables if "time" in t.columns]
        if self.times is None and stored:
            object.__setattr__(self, "times", reduce(DataFrame.union, stored))

    def values(self, axis: str) -> list[float]:
        """Coordinates of an axis, in the order of their indices."""
        return list(self.axes[axis].values())

    @staticmethod
    def dims_of(table: DataFrame) -> tuple[str, ...]:
        return tuple(d for d in DIMS if COLUMNS[d][-1] in table.columns)

    @staticmethod
    def variables_of(table: DataFrame) -> list[str]:
        known = {c for d in DIMS for c in COLUMNS[d]} | set(EXTRA)
        return [c for c in table.columns if c not in known]

    @property
    def dims(self) -> tuple[str, ...]:
        return tuple(d for d in DIMS if any(d in self.dims_of(t) for t in self.tables))

    @property
    def variables(self) -> list[str]:
        return [v for t in self.tables for v in self.variables_of(t)]

    def table_of(self, variable: str) -> DataFrame:
        for t in self.tables:
            if variable in self.variables_of(t):
                return t
        raise ValueError(f"{variable} is not one of {', '.join(sorted(self.variables))}")

    def table(self) -> DataFrame:
        """The only table, for datasets and results whose variables share their dimensions."""
        if len(self.tables) != 1:
            raise ValueError(f"there are {len(self.tables)} tables of different dimensions")
        return self.tables[0]

    def map(self, change) -> GridFrame:
        return replace(self, tables=tuple(change(t) for t in self.tables))

    def select(self, variables: Sequence[str]) -> GridFrame:
        """Only these variables; reaches the scan as column pruning."""
        for v in variables:
            self.table_of(v)
        out = []
        for t in self.tables:
            own = [v for v in self.variables_of(t) if v in variables]
            if own:
                out.append(t.select(*[c for c in t.columns if c not in self.variables_of(t)], *own))
        return replace(self, tables=tuple(out))

    def between(self, dim: str, low: object = None, high: object = None) -> GridFrame:
        """Cells with ``low`` <= coordinate <= ``high``, each side optional; tables without the dimension stay."""
        column = COLUMNS[dim][-1]

        def cut(t: DataFrame) -> DataFrame:
            if column not in t.columns:
                return t
            if low is not None:
                t = t.where(F.col(column) >= F.lit(low))
            return t.where(F.col(column) <= F.lit(high)) if high is not None else t

        axes = dict(self.axes)
        if dim in axes:
            axes[dim] = {i: v for i, v in axes[dim].items() if (low is None or v >= low) and (high is None or v <= high)}
        out = replace(self.map(cut), axes=axes)
        if dim == "time" and self.times is not None:
            out = replace(out, times=cut(self.times))
        return out

    def time_axis(self) -> DataFrame:
        """The distinct times, also those at which no cell is stored."""
        if self.times is None:
            raise ValueError("the dataset has no time axis")
        return self.times.select("time").distinct()

    def first_step(self) -> Column:
        """The first time of the axis, as an expression."""
        return self.time_axis().agg(F.min("time")).scalar()


def keep_columns(table: DataFrame, without: Iterable[str]) -> list[str]:
    """Coordinate columns of the dimensions that are not in ``without``."""
    return [c for d in GridFrame.dims_of(table) if d not in without for c in COLUMNS[d]] + [c for c in EXTRA if c in table.columns and c != "tmask"]


def nearest(values: Sequence[float] | dict[int, float], target: float) -> int:
    """Index of the value nearest to ``target``, the larger of two equally near."""
    by = _numbered(values)
    if not by:
        raise ValueError("the axis has no values")
    return min(by, key=lambda i: (abs(by[i] - target), -by[i]))


def at_index(values: Sequence[float] | dict[int, float], index: Column) -> Column:
    """The value of an index as an expression (null where there is none): axis metadata as an array literal, so that no join is needed."""
    by = _numbered(values)
    if not by:
        return F.lit(None).cast("double")
    low, high = min(by), max(by)
    known = F.array(*[F.lit(None if by.get(i) is None else float(by[i])).cast("double") for i in range(low, high + 1)])
    return F.get(known, index - low)
