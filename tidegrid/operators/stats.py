"""Statistics of each grid cell over time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import GridFrame, keep_columns

OPERATIONS = ("mean", "variance", "median", "minimum", "maximum", "quartiles")
QUARTILES = (5, 25, 75, 95)


RANKS = (5, 25, 50, 75, 95)


def _of(v: str, operation: str) -> list[tuple[str, Column]]:
    """Names and expressions of an operation's results, over ``v`` or over its percentiles at ``RANKS`` in ``_p_v``."""
    if operation == "quartiles":
        return [(f"{v}_quartiles_{p}", F.get(f"_p_{v}", F.lit(RANKS.index(p)))) for p in QUARTILES]
    if operation == "median":
        return [(f"{v}_median", F.get(f"_p_{v}", F.lit(RANKS.index(50))))]
    return [(f"{v}_{operation}", F.col(f"{v}_{operation}"))]


def calculate_stats(frame: GridFrame, operations: Sequence[str] = ("all",)) -> GridFrame:
    """Mean, variance (population), median, minimum, maximum and percentiles 5, 25, 75, 95 (linear) of each cell over time.

    A cell that is missing at any time of the axis has null results; cells never stored have no row. Results are named
    ``variable_operation`` and ``variable_quartiles_p``. ``all`` stands for every operation; together with another
    one, and for duplicates, unknown names or a dataset without time, there is a ValueError. Tables without time are left out.
    """
    operations = list(operations) or ["all"]
    if "all" in operations:
        if len(operations) > 1:
            raise ValueError("all can't be combined with other operations")
        operations = list(OPERATIONS)
    if len(set(operations)) != len(operations):
        raise ValueError("an operation is given twice")
    if unknown := [o for o in operations if o not in OPERATIONS]:
        raise ValueError(f"unknown operations: {', '.join(unknown)}; known are all, {', '.join(OPERATIONS)}")
    if "time" not in frame.dims:
        raise ValueError("the dataset has no time axis")
    steps = frame.time_axis().agg(F.count(F.lit(1)).alias("n"))

    def change(t: DataFrame) -> DataFrame:
        own = GridFrame.variables_of(t)
        cell = keep_columns(t, ["time"])
        simple = {"mean": F.avg, "variance": F.var_pop, "minimum": F.min, "maximum": F.max}
        aggregates = [simple[o](F.col(v).cast("double")).alias(f"{v}_{o}") for v in own for o in operations if o in simple]
        if {"median", "quartiles"} & set(operations):  # one buffer of values for all ranks
            aggregates += [F.percentile(F.col(v).cast("double"), F.array(*[F.lit(p / 100) for p in RANKS])).alias(f"_p_{v}") for v in own]
        counts = [F.count(F.col(v)).alias(f"_n_{v}") for v in own]
        out = t.groupBy(*cell).agg(*aggregates, *counts)
        return out.select(*cell, *[F.when(F.col(f"_n_{v}") == steps.scalar(), c).alias(name) for v in own for o in operations for name, c in _of(v, o)])

    timed = replace(frame, tables=tuple(t for t in frame.tables if "time" in t.columns))
    return replace(timed.map(change), times=None)
