"""The data and the metadata of a plot of a file, by the file's kind."""

from __future__ import annotations

from datetime import datetime

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import COLUMNS, GridFrame, clean
from ..operators.plotdata import map_at, timeseries
from .collection import CATALOGUE, Collection
from .gridfiles import netcdf_frame
from .sinks import read_geotiff
from .store import Location, exists, join, kind
from .tables import read_csv
from .variables import plot_metadata

MODES = ("timeseries", "map")


def opened(spark: SparkSession, path: Location, variable: str) -> GridFrame:
    """The file as a frame: a collection's folder, or Parquet with the columns of a frame's table. A variable that it lacks is a ValueError."""
    if kind(path) == pafs.FileType.Directory and exists(join(path, CATALOGUE)):
        made = Collection.load(path)
        if variable not in made.variables():
            raise ValueError(f"there is no variable {variable} in {path}")
        return made.frame(spark, [variable])
    t = spark.read.parquet(str(path))
    if variable not in t.columns:
        raise ValueError(f"there is no variable {variable} in {path}")
    return GridFrame((clean(t, [variable]),)).select([variable])


def plot_data(
    spark: SparkSession, path: Location, variable: str, mode: str, start: datetime | None = None, end: datetime | None = None,
    time: datetime | None = None, along: str | None = None, how: str = "mean",
) -> tuple[DataFrame, dict[str, str]]:
    """What a plot of ``variable`` shows, and its label, unit and cmap.

    ``mode`` timeseries: the mean over latitude and longitude at each time between start and end; map: values at the step
    nearest to ``time``, reduced along one more axis (see operators.plotdata). A collection, Parquet and NetCDF give both, a GeoTIFF
    a map of its first band, and a CSV file a time series only, from its rows in the order of time. A missing file is a FileNotFoundError; other kinds of files, an unknown mode or
    variable, and a time series without time are ValueErrors."""
    if mode not in MODES:
        raise ValueError(f"the mode must be one of {', '.join(MODES)}, not {mode}")
    if not exists(path):
        raise FileNotFoundError(str(path))
    name = str(path).rstrip("/")
    if name.endswith(".csv"):
        if mode == "map":
            raise ValueError("maps can't be made from CSV files")
        t = read_csv(spark, name)
        if variable not in t.columns:
            raise ValueError(f"there is no variable {variable} in {path}")
        if "time" not in t.columns:
            raise ValueError(f"{variable} has no time")
        flat = [c for c in ("latitude", "longitude") if c in t.columns]
        t = t.where((F.lit(start is None) | (F.col("time") >= F.lit(start))) & (F.lit(end is None) | (F.col("time") <= F.lit(end))))
        keep = ["time", *[c for c in COLUMNS["depth"] if c in t.columns]]
        out = t.groupBy(*keep).agg(F.avg(variable).alias(variable)).orderBy(*keep) if flat else t.select(*keep, variable)
        return out, plot_metadata(variable, labelled=True)
    if name.endswith((".tif", ".tiff")):
        if mode == "timeseries":
            raise ValueError("a GeoTIFF has no time")
        return read_geotiff(spark, name, variable).table(), plot_metadata(variable)
    if name.endswith(".nc"):
        frame = netcdf_frame(spark, name, variable)
    elif kind(path) != pafs.FileType.Directory and not name.endswith(".parquet"):
        raise ValueError(f"{path} is of no known kind; known are collections, .parquet, .nc, .tif and .csv")
    else:
        frame = opened(spark, path, variable)
    if mode == "timeseries":
        if "time" not in frame.dims:
            raise ValueError(f"{variable} has no time")
        return timeseries(frame, variable, start, end), plot_metadata(variable)
    return map_at(frame, variable, time, along, how), plot_metadata(variable)
