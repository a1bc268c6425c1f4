"""Where results go: Parquet, CSV, ESRI ASCII grids, GeoTIFF and NetCDF."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import COLUMNS, GridFrame, at_index
from ..operators.align import align_outer
from ..operators.plotdata import time_mean
from . import tiff
from .dense import append, write_blocks, write_dense
from .netcdf import Layout
from .store import place, remove_folder
from .variables import REGISTRY


def _single(frame: GridFrame) -> tuple[DataFrame, str]:
    if len(frame.variables) != 1:
        raise ValueError(f"exactly one variable can be written, not {len(frame.variables)}")
    return frame.table_of(frame.variables[0]), frame.variables[0]


def write_parquet(frame: GridFrame, path: str) -> None:
    """One folder for each set of dimensions, compressed with zstd; Spark's commit makes it appear as a whole.

    Tables that an analysis has left with equal dimensions (a surface beside a flat variable) are aligned into one."""
    by_dims: dict[tuple[str, ...], list[DataFrame]] = {}
    for t in frame.tables:
        by_dims.setdefault(GridFrame.dims_of(t), []).append(t)
    for dims, tables in by_dims.items():
        whole = tables[0] if len(tables) == 1 else align_outer(tables)
        whole.write.option("compression", "zstd").parquet(f"{path}/{'_'.join(dims) or 'scalar'}")


def csv_table(frame: GridFrame) -> DataFrame:
    """The only variable with its coordinates (without indices) as columns, in their order; more variables are a ValueError."""
    t, v = _single(frame)
    coordinates = [COLUMNS[d][-1] for d in GridFrame.dims_of(t)] + [c for c in ("year", "month", "doy", "season") if c in t.columns]
    return t.select(*coordinates, v).orderBy(*coordinates)


def write_csv(frame: GridFrame, path: str) -> None:
    csv_table(frame).write.csv(path, header=True)


def raster(frame: GridFrame) -> DataFrame:
    """The only variable on latitude and longitude, its mean over time if it has time; other axes are a ValueError."""
    t, v = _single(frame)
    t = time_mean(t)
    if set(GridFrame.dims_of(t)) != {"latitude", "longitude"}:
        raise ValueError(f"a raster has latitude and longitude only, not {', '.join(GridFrame.dims_of(t))}")
    return t.select("lat_idx", "latitude", "lon_idx", "longitude", v)


def ascii_lines(frame: GridFrame, nodata: int = -9999, north_first: bool = True) -> DataFrame:
    """row, line of the body of an ESRI ASCII grid: one line for each latitude of the axis, the north one first.

    Each line is made by one group of at most as many cells as there are longitudes. ``north_first=False`` keeps the axis's order."""
    v = frame.variables[0] if frame.variables else ""
    t = raster(frame)
    lat, lon = list(frame.axes["latitude"]), list(frame.axes["longitude"])
    lines = t.groupBy("lat_idx").agg(F.map_from_entries(F.collect_list(F.struct("lon_idx", F.col(v).alias("x")))).alias("m"))
    every = t.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(i) for i in lat])).alias("_row", "lat_idx"))
    cell = lambda j: F.coalesce(F.format_string("%.8f", F.element_at(F.col("m"), j)), F.lit(str(nodata)))
    empty = F.transform(F.array(*[F.lit(j) for j in lon]), lambda j: F.when(F.element_at(F.col("m"), j).isNull(), F.lit(str(nodata))).otherwise(cell(j)))
    rows = every.join(lines, "lat_idx", "left").withColumn("m", F.coalesce("m", F.expr("map()").cast(lines.schema["m"].dataType)))
    order = (F.lit(len(lat) - 1) - F.col("_row")) if north_first else F.col("_row")
    return rows.select(order.cast("int").alias("row"), F.array_join(empty, " ").alias("line"))


def _step(values: Sequence[float]) -> float | None:
    return (values[-1] - values[0]) / (len(values) - 1) if len(values) > 1 else None


def ascii_header(frame: GridFrame, nodata: int = -9999, compat: bool = False) -> list[str]:
    """Header of the grid: corners are those of the cells, the cell size is the mean of both spacings (or the one there is, or 1).

    ``compat``: as files of older tools have it, with the number of latitudes as ncols and of longitudes as nrows, centres of cells as
    corners, and numbers in full."""
    lat, lon = frame.values("latitude"), frame.values("longitude")
    steps = [s for s in (_step(lat), _step(lon)) if s is not None] or [1.0]
    size = sum(steps) / len(steps)
    if compat:
        return [f"ncols {len(lat)}", f"nrows {len(lon)}", f"xllcorner {min(lon)}", f"yllcorner {min(lat)}", f"cellsize {size}", f"NODATA_value {nodata}"]
    return [f"ncols {len(lon)}", f"nrows {len(lat)}", f"xllcorner {lon[0] - size / 2:.8f}", f"yllcorner {lat[0] - size / 2:.8f}", f"cellsize {size:.8f}", f"NODATA_value {nodata}"]


def _by_rows(frame: GridFrame, north_first: bool) -> tuple[DataFrame, int, int]:
    """The raster's cells by place (stretch: row, at: place in it, value), and the numbers of rows and columns."""
    v = frame.variables[0] if frame.variables else ""
    lat, lon = list(frame.axes["latitude"]), list(frame.axes["longitude"])
    order = lat[::-1] if north_first == (frame.axes["latitude"][lat[0]] <= frame.axes["latitude"][lat[-1]]) else lat
    row, at = ({i: float(k) for k, i in enumerate(of)} for of in (order, lon))
    cells = raster(frame).select(at_index(row, F.col("lat_idx")).alias("stretch"), at_index(at, F.col("lon_idx")).alias("at"), F.col(v).cast("double").alias("value"))
    return cells.where("value is not null"), len(lat), len(lon)


def write_ascii(frame: GridFrame, path: str, nodata: int = -9999, compat: bool = False) -> None:
    """One text file, whose lines are made by tasks and appended in order.

    ``compat``: the header as in :func:`ascii_header`, and rows in the order of the axis."""
    cells, rows, columns = _by_rows(frame, north_first=True)
    if compat:
        lat = list(frame.axes["latitude"])
        north = frame.axes["latitude"][lat[0]] > frame.axes["latitude"][lat[-1]]
        cells = cells if north else cells.withColumn("stretch", F.lit(rows - 1) - F.col("stretch"))
    missing = str(nodata)

    def line(values: np.ndarray) -> bytes:
        return (" ".join(missing if x != x else f"{x:.8f}" for x in values.tolist()) + "\n").encode()

    head = "\n".join(ascii_header(frame, nodata, compat)) + "\n"
    write_dense(path, cells, rows, columns, line, lambda _: head.encode())


def write_ascii_compat(frame: GridFrame, path: str) -> None:
    write_ascii(frame, path, compat=True)


def write_geotiff(frame: GridFrame, path: str) -> None:
    """The raster as a GeoTIFF of one band, north row first, in double precision, missing cells as NaN: a packed strip for each row, made by tasks.

    Coordinates are taken to be evenly spaced, by their mean steps, as the format has no others."""
    cells, rows, columns = _by_rows(frame, north_first=True)
    lat, lon = sorted(frame.values("latitude")), frame.values("longitude")
    dy, dx = _step(lat) or _step(lon) or 1.0, _step(lon) or _step(lat) or 1.0
    write_dense(path, cells, rows, columns, tiff.encode_row, tiff.file_head, lambda lengths: tiff.directory(columns, lengths, lon[0] - dx / 2, lat[-1] + dy / 2, dx, dy))


def read_geotiff(spark: SparkSession, path: str, name: str = "band") -> GridFrame:
    """The first band of a GeoTIFF as cells of latitude and longitude (rows from 0, the north one first); its strips are dealt out over tasks, each read at its place."""
    at = str(path)

    def opened() -> tuple:
        store, where = place(at)
        f = store.open_input_file(where)

        def read(begin: int, n: int) -> bytes:
            f.seek(begin)
            return f.read(n)

        return f, read

    f, read = opened()
    with f:
        r = tiff.read_raster(read)
    lats, lons = r.latitudes(), r.longitudes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, read = opened()
        with f:
            for k in (k for batch in batches for k in batch.column(0).to_pylist()):
                values = tiff.read_strip(r, k, read)
                i, j = np.nonzero(~np.isnan(values))
                rows = i + k * r.rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows.astype(np.int32)), pa.array(np.asarray(lats)[rows]), pa.array(j.astype(np.int32)), pa.array(np.asarray(lons)[j]), pa.array(values[i, j])], ["lat_idx", "latitude", "lon_idx", "longitude", name],
                )

    strips = len(r.offsets)
    cells = spark.range(0, strips, 1, max(1, min(strips, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, f"lat_idx int, latitude double, lon_idx int, longitude double, {name} double")
    return GridFrame((cells,), {"latitude": lats, "longitude": lons})


# How results' own coordinates are told in a NetCDF file.
_SEASONS = ("DJF", "MAM", "JJA", "SON")
_SECONDS = "seconds since 1970-01-01 00:00:00"


def write_netcdf(frame: GridFrame, path: str) -> None:
    """All variables as one NetCDF file (CDF-5, double precision, missing cells as NaN), each made by tasks, a horizontal field at a time.

    Time, and what analyses add (year, month, doy, season), are dimensions with the values that the table has; seasons are numbered as in the attribute labels. Axes are whole. Where a table has
    both month and doy, or a year beside time, the finer one is the dimension. The water mask is a variable of zeros and ones."""
    dims: dict[str, list] = {}
    plans = []
    for t in frame.tables:
        own = [d for d in ("time", "season", "year", "month", "doy", "depth", "latitude", "longitude") if (COLUMNS[d][-1] if d in COLUMNS else d) in t.columns]
        own = [d for d in own if not (d == "month" and "doy" in own or d == "year" and "time" in own)]
        for d in own:
            if d in frame.axes:
                values = frame.values(d)
            else:
                values = sorted(r[0] for r in t.select(d).distinct().collect() if r[0] is not None)  # a coordinate of a result: as many as its steps
            if dims.setdefault(d, values) != values:
                dims[d] = sorted({*dims[d], *values}, key=_SEASONS.index if d == "season" else None)
        plans += [(t, v, own) for v in [*GridFrame.variables_of(t), *[c for c in t.columns if c == "tmask"]]]
    if "season" in dims:
        dims["season"] = [s for s in _SEASONS if s in dims["season"]]
    layout = Layout({d: len(v) for d, v in dims.items()}, {k: v for k, v in frame.attrs.items() if isinstance(v, str)})
    head = []
    for d, values in dims.items():
        about: dict[str, object] = {"time": {"units": _SECONDS, "calendar": "standard"}, "latitude": {"units": "degrees_north"}, "longitude": {"units": "degrees_east"}, "depth": {"units": "m", "positive": "down"}}.get(d, {})
        about = {"labels": " ".join(values)} if d == "season" else about
        numbers = [(x - datetime(1970, 1, 1)).total_seconds() for x in values] if d == "time" else range(len(values)) if d == "season" else values
        layout.variables.append((d, (d,), 6, about))
        head.append(np.asarray(list(numbers), ">f8").tobytes())
    known = {v.name: v.label for v in REGISTRY.all()}
    layout.variables += [(v, tuple(own), 6, {"_FillValue": float("nan")} | ({"long_name": known[v]} if v in known else {})) for _, v, own in plans]
    first, _ = layout.header()
    folder = f"{path}.tmp.{uuid.uuid4().hex}"
    blocks: list[str] = []
    try:
        for k, (t, v, own) in enumerate(plans):
            sizes = [layout.dims[d] for d in own]
            flat = [d for d in own if d in ("latitude", "longitude")]
            width = int(np.prod([layout.dims[d] for d in flat]))
            cells = t.where(F.col(v).isNotNull())
            places = []
            for d in own:
                if d in frame.axes:
                    places.append(at_index({i: float(n) for n, i in enumerate(frame.axes[d])}, F.col(COLUMNS[d][0])))
                else:
                    steps = t.sparkSession.createDataFrame([(x, n) for n, x in enumerate(dims[d])], f"{d} {dict(t.dtypes)[d]}, _{d} long")
                    cells = cells.join(steps, d)
                    places.append(F.col(f"_{d}"))
            outer = len(own) - len(flat)
            pos = lambda ps, ns: sum((p.cast("long") * int(np.prod(ns[i + 1 :])) for i, p in enumerate(ps)), F.lit(0).cast("long"))
            rows = cells.select(pos(places[:outer], sizes[:outer]).alias("stretch"), pos(places[outer:], sizes[outer:]).cast("int").alias("at"), F.col(v).cast("double").alias("value"))
            made = write_blocks(rows, int(np.prod(sizes[:outer])), width, lambda x: x.astype(">f8").tobytes(), f"{folder}/{k}") if np.prod(sizes) else []
            blocks += [p for p, _ in made]
        append(path, first + b"".join(head), blocks)
    finally:
        remove_folder(folder)
