"""Archives of one file for each time and variable, loose in folders or in tar files, as Spark sources."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Callable, Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..frame import COLUMNS
from . import netcdf
from .filenames import ARCHIVE_MEMBER, parse_archive_member
from .gridfiles import coordinates, dims_of
from .store import place

Decoder = Callable[[bytes], pd.DataFrame]


def decode(raw: bytes) -> pd.DataFrame:
    """A member's cells: Parquet, or NetCDF of a classic format, of which every variable with latitude or longitude is a column."""
    if raw[:4] == b"PAR1":
        return pd.read_parquet(io.BytesIO(raw))
    read = lambda at, n: raw[at : at + n]
    header = netcdf.read_header(read)
    out: pd.DataFrame | None = None
    for name, v in header.variables.items():
        if len(v.dims) < 2 or v.kind == 2:
            continue
        dims = dims_of(header, name)
        axes = coordinates(header, dims, name, read)
        values = netcdf.read_values(header, name, read)
        where = np.nonzero(~np.isnan(values))
        columns = {}
        for d, i in zip(dims, where):
            if d == "time":
                columns["time"] = np.asarray(axes[d], "datetime64[us]")[i]
            else:
                columns[COLUMNS[d][0]], columns[COLUMNS[d][1]] = i.astype(np.int32), np.asarray(axes[d])[i]
        own = pd.DataFrame(columns | {name: values[where]})
        out = own if out is None else out.merge(own, how="outer")
    if out is None:
        raise ValueError("the file has no variable on a grid")
    return out


def members(folder: str, variable: str, start: datetime | None = None, end: datetime | None = None) -> list[tuple[str, datetime]]:
    """Paths and times of the members of a variable anywhere under ``folder``, from start to end (inclusive), the earliest first.

    Listed through ``pyarrow.fs``: their names hold colons, which Spark's own file listing doesn't take."""
    store, root = place(folder)
    found = []
    for info in store.get_file_info(pafs.FileSelector(root, recursive=True)):
        if info.type == pafs.FileType.File and re.match(ARCHIVE_MEMBER, info.base_name):
            time, of = parse_archive_member(info.base_name)
            if of == variable and (start is None or time >= start) and (end is None or time <= end):
                found.append((info.path, time))
    return sorted(found, key=lambda m: m[1])


def local_archive(spark: SparkSession, folder: str, variable: str, schema: str, start: datetime | None = None, end: datetime | None = None, decoder: Decoder = decode) -> DataFrame:
    """Cells of the members ``ave.YYYYMMDD-HH:MM:SS.variable.*`` anywhere under ``folder``, from start to end (inclusive).

    ``schema`` is that of the cells, with ``time``. Names are chosen before contents are read, one member in a task at a time;
    no member left is a ValueError."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    found = members(folder, variable, start, end)
    if not found:
        raise ValueError(f"there are no members of {variable} under {folder} in that time")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = place(folder)[0]
        for pdf in batches:
            for path, time in zip(pdf["path"], pdf["time"]):
                with store.open_input_stream(path) as f:
                    yield decoder(f.read()).assign(time=time)[names]

    listed = spark.createDataFrame(found, "path string, time timestamp_ntz")
    return listed.repartition(min(len(found), 4 * spark.sparkContext.defaultParallelism)).mapInPandas(run, schema)


def tar_archive(spark: SparkSession, folder: str, dataset: str, variable: str, schema: str, start: datetime | None = None, end: datetime | None = None, decoder: Decoder = decode) -> DataFrame:
    """Cells of the members of every ``dataset.tar`` under ``folder`` (folders called bottom are skipped), from start to end.

    Members that aren't data files are ignored; a nested one, one with another name, or one of another variable (it goes by its
    own name or the dataset's) is a ValueError. First one task for each tar file reads its headers, passing over the contents;
    then the members are dealt out and each is read at its place, so that a tar file may be larger than any task."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    store, root = place(folder)
    tars = [i.path for i in store.get_file_info(pafs.FileSelector(root, recursive=True)) if i.base_name == f"{dataset}.tar" and "/bottom/" not in i.path]
    if not tars:
        raise ValueError(f"there is no {dataset}.tar under {folder}")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = place(folder)[0]
        for path in (p for pdf in batches for p in pdf["path"]):
            rows = []
            with store.open_input_file(path) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                for member in tar:
                    if not member.isfile() or not member.name.endswith((".nc", ".parquet")):
                        continue
                    if "/" in member.name.removeprefix("./"):
                        raise ValueError(f"{path}: {member.name} is in a folder")
                    time, of = parse_archive_member(member.name.removeprefix("./"))
                    if of not in (variable, dataset):
                        raise ValueError(f"{path}: {member.name} is not of {variable}")
                    if (start is None or time >= start) and (end is None or time <= end):
                        rows.append((path, time, member.offset_data, member.size))
            yield pd.DataFrame(rows, columns=["path", "time", "at", "size"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = place(folder)[0]
        for pdf in batches:
            for path, time, at, size in zip(pdf["path"], pdf["time"], pdf["at"], pdf["size"]):
                with store.open_input_file(path) as f:
                    f.seek(int(at))
                    yield decoder(f.read(int(size))).assign(time=time)[names]

    tasks = 4 * spark.sparkContext.defaultParallelism
    found = spark.createDataFrame([(p,) for p in tars], "path string").repartition(min(len(tars), tasks)).mapInPandas(listed, "path string, time timestamp_ntz, at long, size long")
    return found.repartition(tasks, "path", "at").mapInPandas(run, schema)
