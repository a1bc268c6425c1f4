"""Where data come from: providers, their configuration, and ingestion into a collection."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date, datetime, timedelta

import yaml
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..frame import COLUMNS
from ..functions.calendar import FREQUENCIES, month_start, split_interval
from ..operators.align import Grid, one_numbering, reconciled
from ..operators.domain import BoundingBox, Domain
from .archives import Decoder, decode, local_archive, tar_archive
from .collection import CATALOGUE, Collection, DataFile, as_axis, fault, merge_all
from .filenames import data_file_name
from .mesh import Mesh, read_mesh
from .store import Location, exists, join, make_folder, place, read_text
from .variables import REGISTRY, variables_table

NEEDED = {"variables", "frequencies"}
KEYS = NEEDED | {"name", "kind", "source", "meshmask", "start_date", "end_date"}


class Provider(ABC):
    """A source of cells of variables at a frequency. Subclasses register themselves under ``kind``."""

    kind = ""
    known: dict[str, type[Provider]] = {}

    def __init_subclass__(cls, **more) -> None:
        super().__init_subclass__(**more)
        Provider.known[cls.kind] = cls

    @abstractmethod
    def available_variables(self, frequency: str) -> list[str]:
        """Names of the variables that it has at this frequency."""

    @abstractmethod
    def read(self, spark: SparkSession, variable: str, frequency: str, start: datetime, end: datetime) -> DataFrame:
        """Cells from start to end (inclusive), with the columns of a table of a GridFrame."""

    @abstractmethod
    def describe(self) -> str:
        """One line about it."""


@dataclass(frozen=True)
class ProviderConfig:
    """``variables``: name -> name of its dataset; ``frequencies``: name -> (variables, folder within ``source``, if that isn't empty);
    ``units`` of the variables; ``meshmask``: type and path of the grid's description; ``start`` and ``end`` of what it has."""

    name: str
    kind: str
    source: str
    variables: dict[str, str]
    frequencies: dict[str, tuple[list[str], str]]
    units: dict[str, str | None] = field(default_factory=dict)
    meshmask: dict[str, str] = field(default_factory=dict)
    start: date | None = None
    end: date | None = None


def _entries(path: Location, data: dict, section: str, needed: set[str], more: set[str]) -> list[dict]:
    rows = data[section]
    if not isinstance(rows, list):
        raise ValueError(f"{path}: {section} is not a list")
    for row in rows:
        if not isinstance(row, dict) or not needed <= set(row) <= needed | more:
            raise ValueError(f"{path}: an entry of {section} has the keys {', '.join(sorted(needed))}, not {row}")
    return rows


def read_config(path: Location) -> ProviderConfig:
    """A provider's YAML file; a missing one is a FileNotFoundError.

    ``variables`` (variable, unit, and dataset_name if it differs) and ``frequencies`` (frequency, variables, path) are needed.
    ``source`` is a folder that the paths lie in, or a mapping whose ``type`` is local (paths are then whole); ``kind`` is tar, unless it says
    otherwise; ``name``, ``meshmask`` (a mapping with a type), ``start_date`` and ``end_date`` are optional. Missing or
    unknown keys, variables, kinds and frequencies, a frequency given twice, and a variable of a frequency that isn't described are ValueErrors."""
    if not exists(path):
        raise FileNotFoundError(str(path))
    data = yaml.safe_load(read_text(path))
    if not isinstance(data, dict) or not NEEDED <= set(data) <= KEYS:
        odd = NEEDED - set(data) | set(data) - KEYS if isinstance(data, dict) else NEEDED
        raise ValueError(f"{path}: missing or unknown keys: {', '.join(sorted(map(str, odd)))}")
    kind, source, mask = data.get("kind", "tar"), data.get("source", ""), data.get("meshmask", {})
    if kind not in Provider.known:
        raise ValueError(f"{path}: the kind {kind!r} is unknown; known are {', '.join(sorted(Provider.known))}")
    if isinstance(source, dict):
        if source.get("type") != "local":
            raise ValueError(f"{path}: the source {source} is unknown; known is the type local")
        source = source.get("path", "")
    if not isinstance(mask, dict) or mask and "type" not in mask:
        raise ValueError(f"{path}: meshmask is not a mapping with a type")
    described = _entries(path, data, "variables", {"variable"}, {"unit", "dataset_name"})
    variables = {v["variable"]: v.get("dataset_name", v["variable"]) for v in described}
    REGISTRY.check(list(variables))
    frequencies: dict[str, tuple[list[str], str]] = {}
    for f in _entries(path, data, "frequencies", {"frequency", "variables", "path"}, set()):
        name = str(f["frequency"]).lower()
        if name not in FREQUENCIES:
            raise ValueError(f"{path}: the frequency {name!r} is unknown; known are {', '.join(FREQUENCIES)}")
        if name in frequencies:
            raise ValueError(f"{path}: the frequency {name} is given twice")
        if lost := [v for v in f["variables"] if v not in variables]:
            raise ValueError(f"{path}: variables that aren't described: {', '.join(lost)}")
        frequencies[name] = (list(f["variables"]), str(f["path"]))
    units = {v["variable"]: v.get("unit") for v in described}
    return ProviderConfig(str(data.get("name", "tar_archive")), kind, str(source), variables, frequencies, units, {k: str(v) for k, v in mask.items()}, data.get("start_date"), data.get("end_date"))


class ArchiveProvider(Provider):
    """Archives of one member for each time, as loose files."""

    kind = "local"
    schema = "time timestamp_ntz, depth_idx int, depth double, lat_idx int, latitude double, lon_idx int, longitude double, {} double"

    def __init__(self, config: ProviderConfig, decoder: Decoder = decode) -> None:
        self.config, self.decoder = config, decoder

    def available_variables(self, frequency: str) -> list[str]:
        return list(self.config.frequencies.get(frequency, ([], ""))[0])

    def _folder(self, frequency: str) -> str:
        folder = self.config.frequencies[frequency][1]
        return join(self.config.source, folder) if self.config.source else folder

    def read(self, spark: SparkSession, variable: str, frequency: str, start: datetime, end: datetime) -> DataFrame:
        return local_archive(spark, self._folder(frequency), variable, self.schema.format(variable), start, end, self.decoder)

    def mesh(self, spark: SparkSession) -> Mesh | None:
        """The description of its grid, if its configuration names one."""
        return read_mesh(spark, self.config.meshmask["path"]) if "path" in self.config.meshmask else None

    def describe(self) -> str:
        return f"{self.config.name}: {self.kind} archive at {self.config.source or 'the paths of its frequencies'}"


class TarProvider(ArchiveProvider):
    """The same in tar files, one for each dataset."""

    kind = "tar"

    def read(self, spark: SparkSession, variable: str, frequency: str, start: datetime, end: datetime) -> DataFrame:
        return tar_archive(spark, self._folder(frequency), self.config.variables[variable], variable, self.schema.format(variable), start, end, self.decoder)


def provider_from(path: Location, decoder: Decoder = decode) -> Provider:
    config = read_config(path)
    return Provider.known[config.kind](config, decoder)


def providers_table(spark: SparkSession, providers: list[Provider]) -> DataFrame:
    """description, frequency, variable of what the providers have, each once: the union over providers and frequencies."""
    schema = "description string, frequency string, variable string"
    lists = [spark.createDataFrame([(p.describe(), f, v) for v in p.available_variables(f)], schema) for p in providers for f in FREQUENCIES]
    return merge_all(lists or [spark.createDataFrame([], schema)]).orderBy("description", "frequency", "variable")


def available(spark: SparkSession, providers: list[Provider], frequency: str | None = None) -> DataFrame:
    """name, label, cmap, description, frequency of the variables that providers have, those of one ``frequency`` if it is given; an unknown one is a ValueError."""
    if frequency is not None and frequency not in FREQUENCIES:
        raise ValueError(f"the frequency {frequency!r} is unknown; known are {', '.join(FREQUENCIES)}")
    listed = providers_table(spark, providers).withColumnRenamed("variable", "name")
    listed = listed if frequency is None else listed.where(F.col("frequency") == frequency)
    return listed.join(variables_table(spark), "name").select("name", "label", "cmap", "description", "frequency").orderBy("name", "description", "frequency")


def inside(table: DataFrame, box: BoundingBox) -> DataFrame:
    """Cells in a box, its depth range included; these filters reach the scan of a columnar source."""
    out = table.where(F.col("latitude").between(*box.latitude) & F.col("longitude").between(*box.longitude))
    return out.where(F.col("depth").between(*box.depth)) if box.depth and "depth" in table.columns else out


def ingest(spark: SparkSession, folder: Location, domain: Domain, variables: list[str], frequency: str, start: datetime, end: datetime, provider: Provider, split_by: str | None = None, title: str | None = None) -> Collection:
    """Read variables of a provider within a domain and time into Parquet files under ``folder``, with a catalogue.

    ``split_by``: a file for each month or year, else one for each variable. The catalogue is written before the data, so that
    :func:`resume` can go on; one that is there already is a FileExistsError. Variables that the provider lacks are a ValueError."""
    if exists(join(folder, CATALOGUE)):
        raise FileExistsError(join(folder, CATALOGUE))
    REGISTRY.check(variables)
    if lost := [v for v in variables if v not in provider.available_variables(frequency)]:
        raise ValueError(f"not available at the frequency {frequency}: {', '.join(lost)}")
    parts = split_interval(start, end, split_by) if split_by else [(start, end)]
    files = {v: [DataFile(a, b, v, f"file={data_file_name(domain.name, v, frequency, a, b).removesuffix('.nc')}.parquet") for a, b in parts] for v in variables}
    made = Collection(domain.name, start, end, frequency, provider.kind, files, {}, title or f"{frequency} means", region=domain)
    make_folder(folder)
    made.save(folder)
    return resume(spark, folder, domain, provider)


def _until(files: list[DataFile]) -> list[tuple[DataFile, datetime, bool]]:
    """Each file with the time up to which its cells go, and whether that time belongs to it: a part goes up to the start of the one that follows within a second, so that
    no cell of a part's last second is lost."""
    ordered = sorted(files, key=lambda f: f.start)
    out = []
    for f, after in zip(ordered, [*ordered[1:], None]):
        joins = after is not None and f.end < after.start <= f.end + timedelta(seconds=1)
        out.append((f, after.start if joins else f.end, not joins))
    return out


def with_file(cells: DataFrame, files: list[DataFile], all_files: list[DataFile]) -> DataFrame:
    """``cells`` with ``file``, the name of the file among ``files`` that their time belongs to; cells of no file are left out.

    Files meet cells by month, as a join with a table of (month, file): the plan has one size whatever their number."""
    spark = cells.sparkSession
    chosen = {f.path for f in files}
    rows = [(f.path.removeprefix("file="), f.start, until, last) for f, until, last in _until(all_files) if f.path in chosen]
    parts = spark.createDataFrame(rows, "file string, _start timestamp_ntz, _until timestamp_ntz, _last boolean")
    months = F.sequence(month_start(F.col("_start")), month_start(F.col("_until")), F.expr("interval 1 month"))
    parts = parts.withColumn("_month", F.explode(months))
    own = (F.col("time") >= F.col("_start")) & ((F.col("time") < F.col("_until")) | F.col("_last") & (F.col("time") == F.col("_until")))
    named = cells.withColumn("_month", month_start(F.col("time"))).join(parts, "_month").where(own)
    return named.select(*cells.columns, "file")


def _write_parts(cells: DataFrame, folder: Location, files: list[DataFile], all_files: list[DataFile]) -> None:
    """The files ``files`` from one reading of the cells, in one job of Spark.

    Cells are brought together by file, and files that are much larger than others dealt out over tasks. Tasks write beside the collection; the job's commit puts whole files in place of
    what a stopped job may have left there, and a failing job leaves what was there. Then each file is marked as whole."""
    named = with_file(cells, files, all_files).hint("rebalance", "file")
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("file").parquet(str(folder))
    store, root = place(folder)
    for f in files:  # also those of a time without cells
        store.create_dir(f"{root}/{f.path}", recursive=True)
        store.open_output_stream(f"{root}/{f.path}/_SUCCESS").close()


def _described(spark: SparkSession, folder: Location, files: list[DataFile], schema: StructType) -> list[tuple[DataFile, Grid]]:
    """Written files with their rows, least and largest values, and their axes by index: what is read by later scans, resumes and checks instead of the data.

    Axes come as distinct arrays, each with the files that have it, so that the driver gets an axis once however many files have it."""
    schema = StructType([*schema.fields, StructField("file", StringType())])
    cells = spark.read.schema(schema).option("basePath", str(folder)).parquet(*[join(folder, f.path) for f in files])
    zones = [a for a in ("time", "depth", "latitude", "longitude") if a in cells.columns]
    ends = [f(a).alias(f"{a}_{n}") for a in zones for n, f in (("low", F.min), ("high", F.max))]
    about = {r["file"]: r for r in cells.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), *ends).collect()}
    flat = [a for a in zones if a != "time"]
    entry = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(COLUMNS[a][0]).alias("i"), F.col(a).cast("double").alias("x")) for a in flat])).alias("e")
    axes = cells.select("file", entry).select("file", "e.*").where("i is not null").distinct() if flat else None
    grids: dict[str, Grid] = {}
    if axes is not None:
        whole = axes.groupBy("file", "axis").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("values"))
        for r in whole.groupBy("axis", "values").agg(F.collect_list("file").alias("files")).collect():
            for name in r["files"]:
                grids.setdefault(name, {})[r["axis"]] = {v["i"]: v["x"] for v in r["values"]}
    out = []
    for f in files:
        name = f.path.removeprefix("file=")
        r = about.get(name)
        found = {a: tuple(v.isoformat() if isinstance(v, datetime) else v for v in (r[f"{a}_low"], r[f"{a}_high"])) for a in zones if r[f"{a}_low"] is not None} if r else {}
        out.append((replace(f, rows=r["rows"] if r else 0, zones=found), grids.get(name, {})))
    return out


def _placed(grid: Grid, grids: list[Grid]) -> int:
    """The place of a grid among ``grids``: of one that it goes together with by indices, which then holds both, else a new one."""
    for k, known in enumerate(grids):
        merged = {a: one_numbering([g[a] for g in (known, grid) if a in g]) for a in {*known, *grid}}
        if None not in merged.values():
            grids[k] = {a: merged[a] for a in ("depth", "latitude", "longitude") if a in merged}
            return k
    grids.append(grid)
    return len(grids) - 1


def resume(spark: SparkSession, folder: Location, domain: Domain, provider: Provider, report: Callable[[str], None] = lambda _: None) -> Collection:
    """Make those files of a collection that aren't there yet; a file is there once it is marked as whole and the catalogue describes it.

    Each variable is read once, for the time of all its missing files; for files that are there no job is run. ``report`` gets faults that
    validation finds in what the catalogue keeps of each file."""
    made = Collection.load(folder)
    store, root = place(folder)
    changed = False
    for variable, files in made.files.items():
        marks = store.get_file_info([f"{root}/{f.path}/_SUCCESS" for f in files])
        missing = [f for f, mark in zip(files, marks) if mark.type == pafs.FileType.NotFound or f.rows is None]
        if missing:
            until = max(end for f, end, _ in _until(files) if f in missing)
            cells = inside(provider.read(spark, variable, made.frequency, min(f.start for f in missing), until), domain.box())
            _write_parts(cells, folder, missing, files)
            made.schemas[variable] = ", ".join(f"{n} {t}" for n, t in cells.dtypes)
            new = {f.path: replace(f, grid=_placed(grid, made.grids)) for f, grid in _described(spark, folder, missing, cells.schema)}
            made.files[variable] = [new.get(f.path, f) for f in files]
            changed = True
        for f in made.files[variable]:
            if found := fault(f, made.schemas[variable], domain.box().depth):
                report(f"{f.path}: {found}")
    if changed:
        made.axes = {a: as_axis(v) for a, v in reconciled(made.grids)[0].items()}
        made.save(folder, again=True)
    return Collection.load(folder)
