"""Which points lie in which polygons of a table, by equi-joins on tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..lineage import settled

#: Points of a table that is sent to every task: counted before. What polygons are made into is never sent: Spark would judge it by the size of the files they come from.
BROADCAST_POINTS = 100_000
_NEAR = 1e-6  # share of a tile by which what an edge touches is widened: more than any rounding


def _tile(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("long")


def _edges(polygons: DataFrame) -> DataFrame:
    """polygon, x1, y1, x2, y2: the edges of each ring, the last back to its first vertex."""
    corners = polygons.select("polygon", "ring", F.posexplode("ring").alias("i", "a")).withColumn("b", F.get("ring", (F.col("i") + 1) % F.size("ring")))
    return corners.select("polygon", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2")).where("x1 != x2 or y1 != y2")


def tile_size(polygons: DataFrame) -> float:
    """A 64th of the mean extent of the polygons' boxes; 1 where there are none."""
    sides = [F.array_max(F.transform("ring", lambda p: p[c])) - F.array_min(F.transform("ring", lambda p: p[c])) for c in ("x", "y")]
    mean = polygons.agg(F.avg(F.greatest(*sides))).first()[0]
    return mean / 64 if mean else 1.0


def points_in_polygons(points: DataFrame, polygons: DataFrame, tile: float | None = None) -> DataFrame:
    """x, y, polygon: each distinct point with each polygon that it lies in.

    ``points``: x, y; ``polygons``: polygon (unique), ring (array of x, y; open or closed). Even-odd rule, as in geo.in_polygon, boundaries too. A polygon is covered by tiles of ``tile``
    degrees: those within are runs of each row of tiles, which take their points whole; those that an edge touches are listed, and only their points are compared with the edges of
    their row. Points without coordinates and polygons without a ring are left out. Where there are few points, only rows and tiles that have some are listed."""
    polygons = polygons.select("polygon", "ring").where("ring is not null and size(ring) > 2")
    h = tile_size(polygons) if tile is None else tile
    asked = points.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null").distinct()
    asked = settled(asked.select("x", "y", _tile(F.col("y"), h).alias("row"), _tile(F.col("x"), h).alias("column")))
    few = asked.count() <= BROADCAST_POINTS
    sent = F.broadcast(asked) if few else asked.hint("merge")

    def with_points(t: DataFrame, *keys: str) -> DataFrame:
        return t.join(F.broadcast(asked.select(*keys).distinct()), [*keys], "left_semi") if few else t

    rows = F.sequence(_tile(F.least("y1", "y2") - _NEAR * h, h), _tile(F.greatest("y1", "y2") + _NEAR * h, h))
    edges = settled(with_points(_edges(polygons).withColumn("row", F.explode(rows)), "row"))

    # the part of an edge that lies in its row of tiles, and the tiles that it touches there
    at = lambda y: F.when(F.col("y1") == F.col("y2"), F.col("x1")).otherwise(F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)))
    bottom, top = (F.col("row") - _NEAR) * h, (F.col("row") + 1 + _NEAR) * h
    ends = [F.when(F.col("y1") == F.col("y2"), F.col(x)).otherwise(at(F.greatest(bottom, F.least(top, F.col(y))))) for x, y in (("x1", "y1"), ("x2", "y2"))]
    touched = F.sequence(_tile(F.least(*ends) - _NEAR * h, h), _tile(F.greatest(*ends) + _NEAR * h, h))
    border = with_points(edges.select("polygon", "row", F.explode(touched).alias("column")), "row", "column").distinct().hint("merge")

    # where the middle of a row of tiles is inside: between its first and second crossing, its third and fourth, ...
    middle = (F.col("row") + 0.5) * h
    crossings = edges.where((F.col("y1") > middle) != (F.col("y2") > middle)).select("polygon", "row", at(middle).alias("x"))
    order = Window.partitionBy("polygon", "row").orderBy("x")
    runs = crossings.select("polygon", "row", "x", F.lead("x").over(order).alias("to"), F.row_number().over(order).alias("k")).where("k % 2 = 1")
    runs = runs.select("polygon", "row", _tile(F.col("x"), h).alias("first"), _tile(F.col("to"), h).alias("last"))

    whole = sent.join(runs.hint("merge"), "row").where("column between first and last").join(border, ["polygon", "row", "column"], "left_anti").select("x", "y", "polygon")
    near = sent.join(border, ["row", "column"]).select("x", "y", "row", "polygon")
    crossed = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1"))
    odd = near.join(edges.hint("merge"), ["polygon", "row"]).where(crossed).groupBy("x", "y", "polygon").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    return whole.union(odd.select("x", "y", "polygon"))
