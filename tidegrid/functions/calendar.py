"""Seasons, months and time intervals."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

FREQUENCIES = ("daily", "weekly", "monthly", "yearly")


def season(month: Column) -> Column:
    """DJF, MAM, JJA or SON."""
    return F.when(month.isin(12, 1, 2), "DJF").when(month.isin(3, 4, 5), "MAM").when(month.isin(6, 7, 8), "JJA").otherwise("SON")


def days_in_month(time: Column) -> Column:
    return F.day(F.last_day(time.cast("date")))


def year_start(year: Column) -> Column:
    return F.make_timestamp_ntz(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def month_start(time: Column) -> Column:
    return F.make_timestamp_ntz(F.year(time), F.month(time), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def next_month(time: datetime) -> datetime:
    """Midnight of the first day of the next month."""
    return datetime(time.year + time.month // 12, time.month % 12 + 1, 1)


def next_year(time: datetime) -> datetime:
    return datetime(time.year + 1, 1, 1)


def split_interval(start: datetime, end: datetime, by: str) -> list[tuple[datetime, datetime]]:
    """Consecutive parts of [start, end] that end a second before each month or year begins, the last at ``end``.

    None if start is end; a ValueError if it is later."""
    if by not in ("month", "year"):
        raise ValueError(f"by must be month or year, not {by}")
    if start > end:
        raise ValueError(f"the interval starts at {start}, after its end {end}")
    step = next_month if by == "month" else next_year
    cuts = [start]
    while step(cuts[-1]) < end:
        cuts.append(step(cuts[-1]))
    if cuts[-1] == end:
        return []
    return [(a, b - timedelta(seconds=1)) for a, b in zip(cuts, cuts[1:])] + [(cuts[-1], end)]


def split_intervals(table: DataFrame, by: str, start: str = "start", end: str = "end") -> DataFrame:
    """The same for every row of ``table``: its columns with ``part_start`` and ``part_end``, one row for each part.

    Rows whose start is their end give none; a row whose start is later stops the query with an error."""
    unit = {"month": "MM", "year": "YYYY"}[by]
    months = {"month": 1, "year": 12}[by]
    a, b = F.col(start), F.col(end)
    checked = F.when(a > b, F.raise_error(F.concat(F.lit("an interval starts after its end: "), a.cast("string")))).otherwise(a)
    first = F.add_months(F.trunc(checked.cast("date"), unit), months)
    last = F.when(b > F.trunc(b.cast("date"), unit).cast("timestamp_ntz"), F.trunc(b.cast("date"), unit)).otherwise(F.add_months(F.trunc(b.cast("date"), unit), -months))
    inner = F.when(first <= last, F.sequence(first, last, F.make_ym_interval(F.lit(0), F.lit(months)))).otherwise(F.array().cast("array<date>"))
    # a part begins at the start or a cut and ends before the next cut or at the end: both are functions of the cut alone
    inner = F.concat(F.array(F.lit(None).cast("date")), inner)
    begin = F.coalesce(F.col("_cut").cast("timestamp_ntz"), a)
    following = F.add_months(F.trunc(begin.cast("date"), unit), months).cast("timestamp_ntz")
    end_ = F.when(following < b, following - F.expr("interval 1 second")).otherwise(b)
    rows = table.where((a < b) | (checked > b)).withColumn("_cut", F.explode(inner))
    return rows.select(*table.columns, begin.alias("part_start"), end_.alias("part_end"))


def n_time_steps(start: Column, end: Column, frequency: str) -> Column:
    """Steps of a daily or monthly series from start to end, both included; other frequencies are a ValueError."""
    if frequency == "daily":
        return F.datediff(end.cast("date"), start.cast("date")) + 1
    if frequency == "monthly":
        return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) + 1
    raise ValueError(f"the number of steps is not known for the frequency {frequency}")


def first_month_of_day(times: DataFrame) -> DataFrame:
    """doy -> month of its first occurrence on the time axis (after 28 February the day of the year shifts in leap years)."""
    return times.groupBy(F.dayofyear("time").alias("doy")).agg(F.min_by(F.month("time"), F.col("time")).alias("month"))


def lead_parts(points: DataFrame, by: list[str], column: str = "time") -> DataFrame:
    """Each split point with the next one of the same ``by`` (a dataset, a variable), as ``start`` and ``end``; the last is left out."""
    following = F.lead(column).over(Window.partitionBy(*by).orderBy(column))
    return points.select(*by, F.col(column).alias("start"), following.alias("end")).where("end is not null")
