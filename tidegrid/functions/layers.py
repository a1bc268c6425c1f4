"""Heights of depth layers from the depths of their centres."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def layer_heights(centres: Sequence[float]) -> list[float]:
    """Height of each layer: the first begins at 0, and each centre is the middle of its layer."""
    out, top = [], 0.0
    for c in centres:
        out.append(2 * (c - top))
        top = 2 * c - top
    return out


def layer_heights_table(depths: DataFrame, index: str = "idx", value: str = "depth") -> DataFrame:
    """The same on a depth axis table, in window functions: ``depths`` with a column ``height``.

    A boundary is twice the alternating sum of the centres above it. The axis is one partition: it is as short as a
    model has levels."""
    k = F.row_number().over(Window.orderBy(index)) - 1
    above = Window.orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    signed = F.when(F.col("_k") % 2 == 0, F.col(value)).otherwise(-F.col(value))
    top = F.coalesce(2 * F.sum(signed).over(above) * F.when(F.col("_k") % 2 == 1, 1).otherwise(-1), F.lit(0.0))
    return depths.withColumn("_k", k).withColumn("height", 2 * (F.col(value) - top)).drop("_k")
