"""A collection of data files on disk: Parquet by variable, with a JSON catalogue beside it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import COLUMNS, GridFrame, _numbered, clean
from ..operators.align import Grid, align_outer, along_time, reconciled, reindexed
from ..operators.domain import Domain, cut_to, from_geometry, to_geometry
from ..operators.extract import water_mask
from .store import Location, exists, join, kind, read_text, write_text
from .variables import REGISTRY

CATALOGUE = "geodata_collection.json"
SNAP = 1e-6  # fixed value: how near to 0 a longitude is the meridian


@dataclass(frozen=True)
class DataFile:
    """One file: the time it spans, its variable, and its path within the collection.

    Once it is written also its number of rows, the least and largest value of each of its axes (numbers; times in ISO form), and its grid's place in the collection's list."""

    start: datetime
    end: datetime
    variable: str
    path: str
    rows: int | None = None
    zones: dict[str, tuple] = field(default_factory=dict)
    grid: int | None = None

    def touches(self, start: datetime | None, end: datetime | None, ranges: dict[str, tuple[float, float]]) -> bool:
        """Whether it may hold cells of that time and of these ranges of depth, latitude, longitude; what isn't known may."""
        if self.rows == 0 or (end is not None and self.start > end) or (start is not None and self.end < start):
            return False
        if "time" in self.zones:
            low, high = (datetime.fromisoformat(t) for t in self.zones["time"])
            if (end is not None and low > end) or (start is not None and high < start):
                return False
        return all(axis not in self.zones or self.zones[axis][0] <= high and self.zones[axis][1] >= low for axis, (low, high) in ranges.items())


def _kept(f: DataFile) -> dict:
    out = {"start": f.start.isoformat(), "end": f.end.isoformat(), "variable": f.variable, "path": f.path}
    return out if f.rows is None else out | {"rows": f.rows, "zones": f.zones, "grid": f.grid}


def _by_index(axis: list[float] | dict) -> dict[int, float]:
    return {int(i): v for i, v in axis.items()} if isinstance(axis, dict) else dict(enumerate(axis))


def as_axis(by: dict[int, float]) -> list[float] | dict[int, float]:
    """An axis as a list if its indices count from 0."""
    return list(by.values()) if list(by) == list(range(len(by))) else by


@dataclass
class Collection:
    """Catalogue of a dataset: ``files`` by variable, ``axes`` of depth, latitude and longitude, and how it was made.

    An axis is a list if its indices count from 0, else its values by index: a box keeps the indices of the whole grid. ``grids`` are the axes of the files where these
    have several, ``axes`` is then their union. ``schemas`` of the variables' files; ``region``: the domain whose cells an analysis takes."""

    domain: str
    start: datetime
    end: datetime
    frequency: str
    provider: str
    files: dict[str, list[DataFile]]
    axes: dict[str, list[float] | dict[int, float]] = field(default_factory=dict)
    title: str = ""
    provider_config: str | None = None
    main_path: str | None = None
    grids: list[Grid] = field(default_factory=list)
    schemas: dict[str, str] = field(default_factory=dict)
    region: Domain | None = None

    def save(self, folder: Location, again: bool = False) -> str:
        """Write the catalogue, as a whole; one that is there already is a FileExistsError, unless it is written ``again``."""
        target = join(folder, CATALOGUE)
        if not again and exists(target):
            raise FileExistsError(target)
        by_index = {k: _by_index(v) for k, v in self.axes.items()}
        indices = {k: list(v) for k, v in by_index.items() if list(v) != list(range(len(v)))}
        out = {
            "domain": self.domain, "start": self.start.isoformat(), "end": self.end.isoformat(), "frequency": self.frequency, "provider": self.provider, "provider_config": self.provider_config,
            "title": self.title, "axes": {k: list(v.values()) for k, v in by_index.items()}, "indices": indices, "region": to_geometry(self.region) if self.region else None, "grids": self.grids,
            "schemas": self.schemas, "files": {v: [_kept(f) for f in fs] for v, fs in self.files.items()},
        }
        write_text(target, json.dumps(out, indent=1))
        return target

    @staticmethod
    def load(path: Location) -> Collection:
        """The catalogue at a path or in a folder; a missing one is a FileNotFoundError, a provider config that is missing a ValueError."""
        path = join(path, CATALOGUE) if kind(path) == pafs.FileType.Directory else str(path)
        if not exists(path):
            raise FileNotFoundError(path)
        data = json.loads(read_text(path))
        when = datetime.fromisoformat
        if data["provider_config"] and not exists(data["provider_config"]):
            raise ValueError(f"the provider config {data['provider_config']} does not exist")
        files = {v: [DataFile(when(f["start"]), when(f["end"]), f["variable"], f["path"], f.get("rows"), {k: tuple(z) for k, z in f.get("zones", {}).items()}, f.get("grid")) for f in fs] for v, fs in data["files"].items()}
        axes = {k: dict(zip(data.get("indices", {})[k], v)) if k in data.get("indices", {}) else v for k, v in data["axes"].items()}
        grids = [{k: _by_index(v) for k, v in g.items()} for g in data.get("grids", [])]
        region = from_geometry(data["region"]) if data.get("region") else None
        return Collection(data["domain"], when(data["start"]), when(data["end"]), data["frequency"], data["provider"], files, axes, data["title"], data["provider_config"], path.rpartition("/")[0] or ".", grids, data.get("schemas", {}), region)

    def variables(self) -> list[str]:
        return list(self.files)

    def paths(self, variable: str) -> list[str]:
        """Full paths of a variable's files, the earliest first."""
        return [self._path(f) for f in sorted(self.files[variable], key=lambda f: f.start)]

    def _path(self, f: DataFile) -> str:
        return join(self.main_path, f.path) if self.main_path else f.path

    def wanted(self, variable: str, start: datetime | None = None, end: datetime | None = None, ranges: dict[str, tuple[float, float]] | None = None) -> list[DataFile]:
        """The variable's files that may hold cells of that time and of these ranges, by the values and grids that the catalogue keeps; the earliest first."""
        ranges = ranges or {}
        empty = {k for k, grid in enumerate(self.grids) if any(a in grid and not any(low <= v <= high for v in grid[a].values()) for a, (low, high) in ranges.items())}
        return sorted((f for f in self.files[variable] if f.touches(start, end, ranges) and f.grid not in empty), key=lambda f: f.start)

    def _read(self, spark: SparkSession, variable: str, files: list[DataFile], grid: Grid, remaps: list[dict]) -> DataFrame:
        """The cells of these files: one reading for each grid that they have, however many files there are."""
        schema = self.schemas.get(variable)
        if not files:
            return spark.createDataFrame([], schema)
        by_grid: dict[int | None, list[str]] = {}
        for f in files:
            by_grid.setdefault(f.grid, []).append(self._path(f))
        reader = spark.read.schema(schema) if schema else spark.read
        return along_time([reindexed(reader.parquet(*paths), grid, remaps[k] if k is not None and remaps else {}) for k, paths in by_grid.items()])

    def frame(self, spark: SparkSession, variables: list[str] | None = None, start: datetime | None = None, end: datetime | None = None, ranges: dict[str, tuple[float, float]] | None = None) -> GridFrame:
        """The data of these variables (all, if None), read lazily; files without cells from start to end and in ``ranges`` (of depth, latitude, longitude) aren't read.

        Variables of equal dimensions are aligned in one table, on the outer union of their coordinates where files have different grids. The time axis is that of the
        files, before any cut; longitudes at the meridian are snapped where the axis has one near 0. An empty list of variables is a ValueError."""
        variables = self.variables() if variables is None else list(variables)
        if not variables:
            raise ValueError("there are no variables to read")
        by_dims: dict[tuple[str, ...], list[DataFrame]] = {}
        grid, remaps = reconciled(self.grids) if self.grids else ({}, [])
        axes = {k: _numbered(v) for k, v in self.axes.items()} | grid
        near = [x for x in _values(axes.get("longitude", [])) if abs(x) <= SNAP]
        odd = "longitude" not in axes or any(near)  # else the filters on longitude reach the scan as they are
        if any(near):
            axes["longitude"] = {i: 0.0 if abs(x) <= SNAP else x for i, x in axes["longitude"].items()}
        times: list[DataFrame] = []
        for v in REGISTRY.check(variables):
            wanted = self.wanted(v.name, start, end, ranges)
            if not wanted and v.name not in self.schemas:
                raise ValueError(f"there are no files of {v.name} in that time")
            t = clean(self._read(spark, v.name, wanted, axes, remaps), [v.name])
            if "time" in t.columns:
                times.append(t.select("time"))
            t = snap_longitudes(t) if odd and "longitude" in t.columns else t
            by_dims.setdefault(GridFrame.dims_of(t), []).append(t)
        out = GridFrame(tuple(align_outer(ts) if len(ts) > 1 else ts[0] for ts in by_dims.values()), axes, along_time(times) if times else None, {"title": self.title})
        for axis, (low, high) in (ranges or {}).items():
            out = out.between(axis, low, high)
        return out.between("time", start, end)

    def inside(self, frame: GridFrame) -> GridFrame:
        """The cells of ``frame`` in the collection's own region (all, if it has none): what an analysis takes."""
        return cut_to(frame, self.region) if self.region else frame

    def mask(self, spark: SparkSession) -> DataFrame:
        return water_mask(self.frame(spark))


def _values(axis: list[float] | dict[int, float]) -> list[float]:
    return list(_numbered(axis).values())


def snap_longitudes(table: DataFrame) -> DataFrame:
    """Longitudes within 1e-6 of 0 become 0, so that files written by different models align."""
    return table.withColumn("longitude", F.when(F.abs("longitude") <= SNAP, F.lit(0.0)).otherwise(F.col("longitude")))


def validate(table: DataFrame, variable: str, depth: tuple[float, float] | None = None) -> DataFrame:
    """One row: ok, reason. A data file needs time, latitude and longitude, its variable, and depths from 0 to the domain's lowest."""
    spark = table.sparkSession
    missing = [c for d in ("time", "latitude", "longitude") for c in COLUMNS[d][-1:] if c not in table.columns] + [v for v in [variable] if v not in table.columns]
    if missing:
        return spark.createDataFrame([(False, f"missing: {', '.join(missing)}")], "ok boolean, reason string")
    if depth is None or "depth" not in table.columns:
        return spark.createDataFrame([(True, "")], "ok boolean, reason string")
    low, high = F.min("depth"), F.max("depth")
    ok = F.coalesce((low >= 0) & (high <= depth[1]), F.lit(True))
    return table.agg(ok.alias("ok"), F.when(ok, "").otherwise(F.concat(F.lit("depths from "), low.cast("string"), F.lit(" to "), high.cast("string"))).alias("reason"))


def fault(f: DataFile, schema: str, depth: tuple[float, float] | None = None) -> str:
    """What :func:`validate` finds in a written file, from the values that the catalogue keeps of it: no data are read."""
    columns = {x.strip().split(" ")[0] for x in schema.split(",")}
    missing = [c for c in ("time", "latitude", "longitude", f.variable) if c not in columns]
    if missing:
        return f"missing: {', '.join(missing)}"
    low, high = f.zones.get("depth", (None, None))
    if depth is None or low is None or low >= 0 and high <= depth[1]:
        return ""
    return f"depths from {low} to {high}"


def wanted_files(spark: SparkSession, domain: str, variables: list[str], frequency: str, parts: list[tuple[datetime, datetime]]) -> DataFrame:
    """variable, start, end, name of the files that a download of these parts makes."""
    from .filenames import data_file_name_column

    names = spark.createDataFrame([(v.name,) for v in REGISTRY.check(variables)], "variable string")
    times = spark.createDataFrame(parts, "start timestamp_ntz, end timestamp_ntz")
    out = names.withColumn("part", F.explode(times.agg(F.collect_list(F.struct("start", "end"))).scalar())).select("variable", "part.start", "part.end")
    return out.withColumn("name", data_file_name_column(F.lit(domain), F.col("variable"), F.lit(frequency), F.col("start"), F.col("end")))


def missing_files(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Files of ``wanted`` that aren't in ``present`` (name): what a resumed download still has to make."""
    return wanted.join(present.select("name"), "name", "left_anti").select(*wanted.columns)


def merge_all(tables: list[DataFrame]) -> DataFrame:
    """Distinct rows of all tables, such as what providers list for different frequencies (see providers.providers_table)."""
    return reduce(lambda a, b: a.unionByName(b), tables).distinct()
