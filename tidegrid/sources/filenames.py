"""Names of data files: domain_variable_frequency_start--end.nc, and of archive members: ave.date-time.variable.nc."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats of the names.
DATA_FILE = r"^(?<domain>[a-zA-Z0-9-]+)_(?<variable>[\w-]+)_(?<frequency>[a-zA-Z0-9-]+)_(?<start>\d{4}-\d{2}-\d{2})--(?<end>\d{4}-\d{2}-\d{2})\.nc$"
ARCHIVE_MEMBER = r"^ave\.(\d{8}-\d{2}:\d{2}:\d{2})\.([\w-]+)\.(nc|parquet)$"
_GROUPS = ("domain", "variable", "frequency", "start", "end")


def data_file_name(domain: str, variable: str, frequency: str, start: datetime, end: datetime) -> str:
    return f"{domain}_{variable}_{frequency}_{start:%Y-%m-%d}--{end:%Y-%m-%d}.nc"


def parse_data_file_name(name: str) -> dict[str, object]:
    """Parts of a data file's name, start and end as datetimes; another name is a ValueError."""
    m = re.match(DATA_FILE.replace("(?<", "(?P<"), name)
    if not m:
        raise ValueError(f"{name!r} is not the name of a data file")
    return m.groupdict() | {k: datetime.strptime(m[k], "%Y-%m-%d") for k in ("start", "end")}


def data_file_name_column(domain: Column, variable: Column, frequency: Column, start: Column, end: Column) -> Column:
    return F.concat(domain, F.lit("_"), variable, F.lit("_"), frequency, F.lit("_"), F.date_format(start, "yyyy-MM-dd"), F.lit("--"), F.date_format(end, "yyyy-MM-dd"), F.lit(".nc"))


def data_file_parts(name: Column) -> list[Column]:
    """domain, variable, frequency, start and end (dates) of a column of names; null where a name has another form."""
    hit = name.rlike(DATA_FILE)
    out = [F.when(hit, F.regexp_extract(name, DATA_FILE, i + 1)) for i in range(len(_GROUPS))]
    return [c.cast("date").alias(g) if g in ("start", "end") else c.alias(g) for g, c in zip(_GROUPS, out)]


def parse_archive_member(name: str) -> tuple[datetime, str]:
    """Time and variable of an archive member; another name is a ValueError."""
    m = re.match(ARCHIVE_MEMBER, name)
    if not m:
        raise ValueError(f"{name!r} is not the name of an archive member")
    return datetime.strptime(m[1], "%Y%m%d-%H:%M:%S"), m[2]
