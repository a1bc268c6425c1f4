"""NetCDF files and archives of members as a data source: ``spark.read.format("tidegrid").options(path=..., variable=...)``.

Partitions are stretches of time steps. Ranges of time, depth, latitude and longitude are options of the source: members whose time (in their names) is out of the range are never opened, nor
are steps, levels and rows of latitude read that a file's own coordinates leave out. They are no pushed filters, as Spark 4.1 keeps those of a Python source for later plans of the same
DataFrame, which then lack rows.
"""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..frame import COLUMNS, DIMS, GridFrame
from . import netcdf
from .filenames import parse_archive_member
from .store import place

FORMAT = "tidegrid"
_ALIASES = {"time": ("time", "time_counter"), "depth": ("depth", "deptht", "lev"), "latitude": ("latitude", "lat"), "longitude": ("longitude", "lon")}
_STRETCH = 64 << 20  # bytes of values that a partition reads, about
_TYPES = {"time": "time timestamp_ntz", "depth": "depth_idx int, depth double", "latitude": "lat_idx int, latitude double", "longitude": "lon_idx int, longitude double"}
Read = Callable[[int, int], bytes]


@dataclass
class Member:
    """A file, or a piece of one: ``at`` and ``size`` of its bytes (all, if None), its time by its name, or None."""

    path: str
    at: int = 0
    size: int | None = None
    time: datetime | None = None


@dataclass
class Stretch(InputPartition):
    """Steps of a member (all, if None)."""

    member: Member
    steps: tuple[int, int] | None = None


def _bytes_of(f: pa.NativeFile, m: Member) -> Read:
    def read(at: int, n: int) -> bytes:
        f.seek(m.at + at)
        return f.read(n if m.size is None else max(0, min(n, m.size - at)))

    return read


def dims_of(header: netcdf.Header, variable: str) -> tuple[str, ...]:
    """The dimensions of a variable by their usual names; a variable that isn't there, and dimensions that are unknown or in another order, are a ValueError."""
    if variable not in header.variables:
        raise ValueError(f"there is no variable {variable}; there are {', '.join(header.variables)}")
    out = tuple(next((n for n, known in _ALIASES.items() if d.lower() in known), d) for d in header.variables[variable].dims)
    if list(out) != [d for d in DIMS if d in out]:
        raise ValueError(f"{variable} has the dimensions {', '.join(out)}; known, in this order, are {', '.join(DIMS)}")
    return out


def coordinates(header: netcdf.Header, dims: Sequence[str], variable: str, read: Read) -> dict[str, list]:
    """The values of a variable's dimensions: times as datetimes, the others as numbers."""
    out: dict[str, list] = {}
    for own, name in zip(header.variables[variable].dims, dims):
        if own not in header.variables:
            raise ValueError(f"the dimension {own} has no coordinates")
        values = netcdf.read_values(header, own, read)
        out[name] = netcdf.times_of(values, str(header.variables[own].attributes.get("units", ""))) if name == "time" else values.tolist()
    return out


def list_members(path: str, variable: str, dataset: str | None = None) -> list[Member]:
    """What is to be read: a file; the .nc files of a folder; members ``ave.date.variable.*`` anywhere under a folder; or, with ``dataset``, those of every ``dataset.tar`` there."""
    store, root = place(path)
    if store.get_file_info(root).type == pafs.FileType.File and not dataset:
        return [Member(path)]
    infos = [i for i in store.get_file_info(pafs.FileSelector(root, recursive=True)) if i.type == pafs.FileType.File]
    scheme = path.partition("://")[0] + "://" if "://" in path else ""
    out = []
    if dataset:
        for i in infos:
            if i.base_name == f"{dataset}.tar" and "/bottom/" not in i.path:
                with store.open_input_file(i.path) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith((".nc", ".parquet")):
                            time, of = parse_archive_member(m.name.removeprefix("./"))
                            if of in (variable, dataset):
                                out.append(Member(scheme + i.path, m.offset_data, m.size, time))
        return sorted(out, key=lambda m: (m.time, m.path))
    for i in infos:
        try:
            time, of = parse_archive_member(i.base_name)
        except ValueError:
            if i.base_name.endswith(".nc"):
                out.append(Member(scheme + i.path))
            continue
        if of == variable:
            out.append(Member(scheme + i.path, time=time))
    return sorted(out, key=lambda m: (m.time or datetime.min, m.path))


def range_of(axis: str, text: str) -> tuple:
    """The ends of a range as an option has it, None for an open one."""
    low, dots, high = text.partition("..")
    if not dots:
        raise ValueError(f"the range of {axis} is two ends with two dots between, not {text!r}")
    one = datetime.fromisoformat if axis == "time" else float
    return (one(low) if low else None), (one(high) if high else None)


class GridFiles(DataSource):
    """Options: ``path``, ``variable``, for tar files ``dataset``, and ranges as ``time``, ``depth``, ``latitude``, ``longitude``: from and to, inclusive, with two dots between; either may be empty."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _members(self) -> list[Member]:
        if not self.options.get("path") or not self.options.get("variable"):
            raise ValueError("the options path and variable are needed")
        found = list_members(self.options["path"], self.options["variable"], self.options.get("dataset"))
        if not found:
            raise ValueError(f"there is nothing of {self.options['variable']} under {self.options['path']}")
        return found

    def schema(self) -> str:
        m, variable = self._members()[0], self.options["variable"]
        with place(m.path)[0].open_input_file(place(m.path)[1]) as f:
            read = _bytes_of(f, m)
            if read(0, 4) == b"PAR1":
                names = pq.read_schema(io.BytesIO(read(0, m.size or f.size()))).names
                dims = [d for d in DIMS if d == "time" or COLUMNS[d][-1] in names]
            else:
                dims = list(dims_of(netcdf.read_header(read), variable))
                dims = dims if "time" in dims or m.time is None else ["time", *dims]
        return ", ".join([*[_TYPES[d] for d in dims], f"{variable} double"])

    def reader(self, schema) -> GridReader:
        return GridReader(self._members(), self.options["variable"], schema.names, {d: range_of(d, self.options[d]) for d in DIMS if self.options.get(d)})


class GridReader(DataSourceReader):
    def __init__(self, members: list[Member], variable: str, names: list[str], ranges: dict[str, tuple]) -> None:
        self.members, self.variable, self.names, self.ranges = members, variable, names, ranges

    def _in(self, axis: str, value: object) -> bool:
        low, high = self.ranges.get(axis, (None, None))
        return (low is None or value >= low) and (high is None or value <= high)

    def partitions(self) -> list[Stretch]:
        out = []
        for m in self.members:
            if m.time is not None:
                if self._in("time", m.time):
                    out.append(Stretch(m))
                continue
            with place(m.path)[0].open_input_file(place(m.path)[1]) as f:
                header = netcdf.read_header(_bytes_of(f, m))
            dims, shape = dims_of(header, self.variable), header.shape(self.variable)
            if dims[0] != "time":
                out.append(Stretch(m))
                continue
            each = max(1, _STRETCH // max(1, header.variables[self.variable].dtype.itemsize * int(np.prod(shape[1:]))))
            out += [Stretch(m, (a, min(a + each, shape[0]))) for a in range(0, shape[0], each)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        m = partition.member
        with place(m.path)[0].open_input_file(place(m.path)[1]) as f:
            read = _bytes_of(f, m)
            if read(0, 4) == b"PAR1":
                table = pq.read_table(io.BytesIO(read(0, m.size or f.size())), columns=[n for n in self.names if n != "time"])
                columns = {n: table[n].combine_chunks() for n in table.column_names} | {"time": pa.array([m.time] * len(table), pa.timestamp("us"))}
                yield self._batch(columns)
                return
            header = netcdf.read_header(read)
            dims = dims_of(header, self.variable)
            axes = coordinates(header, dims, self.variable, read)
            kept = {d: [i for i, v in enumerate(axes[d]) if self._in(d, v)] for d in dims}
            if "time" in dims and partition.steps:
                kept["time"] = [i for i in kept["time"] if partition.steps[0] <= i < partition.steps[1]]
            if not all(kept.values()):
                return
            rows = (kept["latitude"][0], kept["latitude"][-1] + 1) if "latitude" in dims else None
            outer = [d for d in dims if d in ("time", "depth")]
            for index in np.ndindex(*[len(kept[d]) for d in outer]):
                at = tuple(kept[d][i] for d, i in zip(outer, index))
                values = netcdf.read_values(header, self.variable, read, at, rows)
                yield self._cells(dims, axes, dict(zip(outer, at)), values, rows[0] if rows else 0, m.time)

    def _cells(self, dims: Sequence[str], axes: dict[str, list], at: dict[str, int], values: np.ndarray, first: int, time: datetime | None) -> pa.RecordBatch:
        """The cells with data of one step and level."""
        inner = [d for d in dims if d not in at]
        where = np.nonzero(~np.isnan(values)) if inner else ((np.zeros(1, int),) if not np.isnan(values) else (np.zeros(0, int),))
        n = len(where[0])
        columns: dict[str, pa.Array] = {self.variable: pa.array(np.asarray(values[where] if inner else np.repeat(values, n), np.float64))}
        for k, d in enumerate(inner):
            i = where[k] + (first if d == "latitude" else 0)
            columns[COLUMNS[d][0]], columns[COLUMNS[d][1]] = pa.array(i.astype(np.int32)), pa.array(np.asarray(axes[d], np.float64)[i])
        if "depth" in at:
            columns["depth_idx"], columns["depth"] = pa.array(np.full(n, at["depth"], np.int32)), pa.array(np.full(n, axes["depth"][at["depth"]]))
        when = axes["time"][at["time"]] if "time" in at else time
        columns["time"] = pa.array([when] * n, pa.timestamp("us"))
        return self._batch(columns)

    def _batch(self, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        kinds = {"time": pa.timestamp("us"), "depth_idx": pa.int32(), "lat_idx": pa.int32(), "lon_idx": pa.int32()}
        return pa.RecordBatch.from_arrays([columns[n].cast(kinds.get(n, pa.float64())) for n in self.names], self.names)


def read_grid(spark: SparkSession, path: str, variable: str, dataset: str | None = None, between: dict[str, tuple] | None = None) -> DataFrame:
    """Cells with data of a variable, from NetCDF files or archives (see :func:`list_members`), with coordinates ``between`` (axis -> lowest, highest; either may be None)."""
    spark.dataSource.register(GridFiles)
    reader = spark.read.format(FORMAT).option("path", path).option("variable", variable)
    reader = reader.option("dataset", dataset) if dataset else reader
    text = lambda v: "" if v is None else v.isoformat() if isinstance(v, datetime) else repr(float(v))
    for axis, (low, high) in (between or {}).items():
        reader = reader.option(axis, f"{text(low)}..{text(high)}")
    out = reader.load()
    for axis, (low, high) in (between or {}).items():
        out = out if low is None else out.where(F.col(axis) >= F.lit(low))
        out = out if high is None else out.where(F.col(axis) <= F.lit(high))
    return out


def netcdf_frame(spark: SparkSession, path: str, variable: str) -> GridFrame:
    """One NetCDF file's variable as a dataset, with all of its axes; cells of the file without values have no rows, its times are all on the time axis."""
    with place(path)[0].open_input_file(place(path)[1]) as f:
        read = _bytes_of(f, Member(path))
        header = netcdf.read_header(read)
        dims = dims_of(header, variable)
        axes = coordinates(header, dims, variable, read)
    times = spark.createDataFrame([(t,) for t in axes["time"]], "time timestamp_ntz") if "time" in dims else None
    return GridFrame((read_grid(spark, path, variable),), {d: axes[d] for d in dims if d != "time"}, times, {k: v for k, v in header.attributes.items() if isinstance(v, str)})
