"""CSV tables, and grids derived from star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import GridFrame, at_index
from ..functions.calendar import month_start
from .variables import REGISTRY

DEPTHS = [0.5, 2.0, 5.0, 10.0, 20.0, 40.0, 80.0]
LATITUDES = [42.0, 43.0, 44.0, 45.0]
LONGITUDES = [30.0, 30.5, 31.0, 31.5, 32.0]


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV table with a header; ``time``, if there is one, as a timestamp and in its order. Give the schema of large files."""
    reader = spark.read.option("header", "true")
    t = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", "true").csv(path)
    if "time" not in t.columns:
        return t
    return t.withColumn("time", F.col("time").cast("timestamp_ntz")).orderBy("time")


def csv_variables(table: DataFrame) -> list[str]:
    """Which of its columns are known variables."""
    known = {v.name for v in REGISTRY.all()}
    return [c for c in table.columns if c in known]


def _coordinates(t: DataFrame) -> DataFrame:
    return t.withColumns({"depth": at_index(DEPTHS, F.col("depth_idx")), "latitude": at_index(LATITUDES, F.col("lat_idx")), "longitude": at_index(LONGITUDES, F.col("lon_idx"))})


def monthly_cube(spark: SparkSession, sf_dir: str) -> GridFrame:
    """Months x 7 depths x 4 latitudes x 5 longitudes from ``lineitem``: thetao, so; columns get shallower by a fixed bathymetry."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber <= 7 - pmod((l_suppkey % 4) * 5 + l_partkey % 5, 8)")
    keys = [month_start(F.col("l_shipdate")).alias("time"), (F.col("l_linenumber") - 1).cast("int").alias("depth_idx"), (F.col("l_suppkey") % 4).cast("int").alias("lat_idx"), (F.col("l_partkey") % 5).cast("int").alias("lon_idx")]
    cells = li.groupBy(*keys).agg(F.avg("l_quantity").alias("thetao"), F.avg("l_extendedprice").alias("so"))
    cells = _coordinates(cells).select("time", "depth_idx", "depth", "lat_idx", "latitude", "lon_idx", "longitude", "thetao", "so")
    return GridFrame((cells,), {"depth": DEPTHS, "latitude": LATITUDES, "longitude": LONGITUDES}, li.select(keys[0]), {"title": "monthly means"})


def daily_cube(spark: SparkSession, sf_dir: str) -> GridFrame:
    """Days x 2 latitudes x 2 longitudes from ``lineitem``: chl."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    keys = [F.col("l_shipdate").cast("date").cast("timestamp_ntz").alias("time"), (F.col("l_suppkey") % 2).cast("int").alias("lat_idx"), (F.col("l_partkey") % 2).cast("int").alias("lon_idx")]
    cells = li.groupBy(*keys).agg(F.avg("l_quantity").alias("chl"))
    cells = cells.withColumns({"latitude": at_index(LATITUDES[:2], F.col("lat_idx")), "longitude": at_index(LONGITUDES[:2], F.col("lon_idx"))})
    return GridFrame((cells.select("time", "lat_idx", "latitude", "lon_idx", "longitude", "chl"),), {"latitude": LATITUDES[:2], "longitude": LONGITUDES[:2]}, li.select(keys[0]), {"title": "daily means"})


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points from ``orders``: pid, latitude, longitude, time."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("pid"), (F.lit(42.0) + F.col("o_custkey") % 31 * F.lit(0.1)).alias("latitude"), (F.lit(30.0) + F.col("o_custkey") % 21 * F.lit(0.1)).alias("longitude"), F.col("o_orderdate").cast("timestamp_ntz").alias("time"))
