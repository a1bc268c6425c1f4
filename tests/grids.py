"""Small grids made of literal rows."""

from datetime import datetime

import numpy as np

from tidegrid.frame import GridFrame

DEPTHS, LATS, LONS = [0.5, 2.0, 5.0], [42.0, 43.0, 44.0, 45.0], [30.0, 30.5, 31.0, 31.5, 32.0]
SCHEMA = "time timestamp_ntz, depth_idx int, depth double, lat_idx int, latitude double, lon_idx int, longitude double, thetao double, so double"
TIMES = [datetime(2025, 1, 1), datetime(2025, 1, 2)]


def values(times=TIMES, seed=0):
    """thetao and so as arrays (time, depth, latitude, longitude), NaN on land; the water reaches down from the surface."""
    gen = np.random.default_rng(seed)
    out = gen.normal(15, 3, (2, len(times), 3, 4, 5))
    k = np.arange(20).reshape(4, 5)
    out[:, :, :, k % 5 == 0] = np.nan
    out[:, :, 1:, k % 4 == 0] = np.nan
    out[:, :, 2:, k % 3 == 0] = np.nan
    return out


def frame(spark, data=None, times=TIMES, title="daily means", flat=False):
    """The arrays as a GridFrame; ``flat`` adds mlotst, the surface of thetao, on a table without depth."""
    data = values(times) if data is None else data
    rows, surface = [], []
    for t, d, y, x in np.ndindex(data.shape[1:]):
        a, b = data[:, t, d, y, x]
        if np.isnan(a) and np.isnan(b):
            continue
        rows.append((times[t], d, DEPTHS[d], y, LATS[y], x, LONS[x], None if np.isnan(a) else float(a), None if np.isnan(b) else float(b)))
        if d == 0:
            surface.append((times[t], y, LATS[y], x, LONS[x], float(a)))
    tables = [spark.createDataFrame(rows, SCHEMA)]
    if flat:
        tables.append(spark.createDataFrame(surface, "time timestamp_ntz, lat_idx int, latitude double, lon_idx int, longitude double, mlotst double"))
    return GridFrame(tuple(tables), {"depth": DEPTHS, "latitude": LATS, "longitude": LONS}, attrs={"title": title})


def by_key(df, keys, value):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}
