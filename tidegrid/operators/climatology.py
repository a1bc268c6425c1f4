"""Climatologies: the mean year of a monthly or daily series."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import GridFrame, keep_columns
from ..functions.calendar import days_in_month, first_month_of_day, season

FREQUENCIES = ("daily", "monthly", "seasonal")


def source_frequency(title: str) -> str:
    """monthly or daily, by the title of the dataset; monthly is looked for first."""
    for word in ("monthly", "daily"):
        if word in title.lower():
            return word
    raise ValueError(f"the title {title!r} names neither a monthly nor a daily dataset")


def _monthly_from_monthly(t: DataFrame, times: DataFrame, v: str) -> DataFrame:
    """Sum of value times days over sum of days of all months of that name, missing ones too.

    Every stored cell has a row for every month of the axis; one without any value there is 0."""
    cell = keep_columns(t, ["time"])
    days = times.groupBy(F.month("time").alias("month")).agg(F.sum(days_in_month(F.col("time"))).alias("days"))
    sums = t.groupBy(F.month("time").alias("month"), *cell).agg(F.sum(F.col(v).cast("double") * days_in_month(F.col("time"))).alias("total"))
    # every cell for each of at most twelve months: an array on the cell, not a join
    months = days.agg(F.sort_array(F.collect_list(F.struct("month", "days"))).alias("m"))
    cells = t.select(*cell).distinct().withColumn("m", F.explode(months.scalar())).select(*cell, "m.month", "m.days")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ["month", *cell]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    out = cells.alias("a").join(sums.alias("b"), on, "left")
    return out.select(*[F.col(f"a.{c}").alias(c) for c in ["month", *cell]], (F.coalesce(F.col("b.total"), F.lit(0.0)) / F.col("a.days")).alias(v))


def climatology(frame: GridFrame, variable: str, frequency: str, start_date: datetime | None = None, end_date: datetime | None = None) -> GridFrame:
    """The mean year of ``variable`` at a daily, monthly or seasonal frequency, over the times from start to end (inclusive).

    From a monthly source: months are weighted by their days, seasons are plain means of their months. From a daily source: days are
    means by day of the year (with the month of that day's first occurrence on the time axis); months and seasons are
    means of those. Seasons take December from its own year. The result has ``month``, ``season``, or ``doy`` and ``month``.

    An unknown variable or frequency, a title that tells no source frequency, and daily from monthly are ValueErrors.
    """
    t = frame.select([variable]).table_of(variable)
    if frequency not in FREQUENCIES:
        raise ValueError(f"the frequency must be one of {', '.join(FREQUENCIES)}, not {frequency}")
    source = source_frequency(frame.attrs["title"])
    frame = replace(frame.select([variable]), tables=(t,)).between("time", start_date, end_date)
    t, times = frame.tables[0], frame.time_axis()
    cell = keep_columns(t, ["time"])
    mean = F.avg(F.col(variable).cast("double")).alias(variable)
    if source == "monthly":
        if frequency == "daily":
            raise ValueError("a daily climatology needs a daily dataset")
        if frequency == "monthly":
            out = _monthly_from_monthly(t, times, variable)
        else:
            out = t.groupBy(season(F.month("time")).alias("season"), *cell).agg(mean)
    else:
        days = t.groupBy(F.dayofyear("time").alias("doy"), *cell).agg(mean).join(first_month_of_day(times), "doy")  # at most 366 rows
        if frequency == "daily":
            out = days.select("doy", "month", *cell, variable)
        elif frequency == "monthly":
            out = days.groupBy("month", *cell).agg(mean)
        else:
            out = days.groupBy(season(F.col("month")).alias("season"), *cell).agg(mean)
    return replace(frame, tables=(out,), times=None)
