import itertools
import math
import warnings

import numpy as np
import pytest

from tests.grids import DEPTHS, LATS, LONS, TIMES, by_key, frame, values
from tidegrid.functions.geo import area_factors
from tidegrid.functions.layers import layer_heights, layer_heights_table
from tidegrid.operators.actions import ActionNotFound, run_action
from tidegrid.operators.reduce import compute_depth_average, compute_depth_integral, reduce_axes

AXES = ("time", "depth", "latitude", "longitude")
COLUMN = {"time": "time", "depth": "depth_idx", "latitude": "lat_idx", "longitude": "lon_idx"}


def naive(data, axes, operator):
    """The definition, on arrays: weights by loops, no library of ours but the area formula."""
    w = np.ones(data.shape)
    if "depth" in axes:
        w = w * np.array([1.0, 2.0, 4.0])[None, :, None, None]
    if "latitude" in axes and "longitude" in axes:
        rows, columns = area_factors(LATS, LONS)
        w = w * np.outer(rows, columns)[None, None]
    elif "latitude" in axes:
        w = w * np.array(LATS)[None, None, :, None]
    elif "longitude" in axes:
        w = w * np.array(LONS)[None, None, None, :]
    over = tuple(i for i, a in enumerate(AXES) if a in axes)
    known = ~np.isnan(data)
    total = np.where(known, data * w, 0).sum(axis=over)
    weight = np.where(known, w, 0).sum(axis=over)
    some = known.sum(axis=over) > 0
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(some, total if operator == "integral" else total / weight, np.nan)


@pytest.mark.parametrize("axes", [a for n in (1, 2, 4) for a in itertools.combinations(AXES, n)])
@pytest.mark.parametrize("operator", ["mean", "integral"])
def test_weighted_reductions_match_arrays(spark, axes, operator):
    data = values()
    out = reduce_axes(frame(spark, data), axes, operator=operator).table()
    expected = naive(data[0], axes, operator)
    left = [a for a in AXES if a not in axes]
    got = by_key(out, [COLUMN[a] for a in left], "thetao")
    assert len(got) == (~np.isnan(expected)).sum()
    for key, x in got.items():
        at = tuple(TIMES.index(k) if a == "time" else k for a, k in zip(left, key))
        assert math.isclose(x, expected[at], rel_tol=1e-9)


@pytest.mark.parametrize("operator", ["max", "min"])
def test_max_and_min_are_unweighted(spark, operator):
    data = values()
    got = by_key(reduce_axes(frame(spark, data), ["depth", "time"], operator=operator).table(), ["lat_idx", "lon_idx"], "so")
    f = np.nanmax if operator == "max" else np.nanmin
    for (y, x), v in got.items():
        assert v == f(data[1][:, :, y, x])


def test_golden_depth_slice(spark):
    data = np.stack([np.tile(np.array([0.0, 3.0, 99.0])[None, :, None, None], (2, 1, 4, 5)), np.tile(np.array([10.0, 13.0, 99.0])[None, :, None, None], (2, 1, 4, 5))])
    mean = compute_depth_average(frame(spark, data), 0.0, 3.0).table().select("thetao", "so").distinct().collect()
    assert [tuple(r) for r in mean] == [(2.0, 12.0)]
    total = compute_depth_integral(frame(spark, data), 0.0, 3.0).table().select("thetao", "so").distinct().collect()
    assert [tuple(r) for r in total] == [(6.0, 36.0)]


def test_heights_are_of_the_slice(spark):
    assert layer_heights(DEPTHS) == [1, 2, 4]
    assert layer_heights([2.0, 5.0]) == [4, 2]
    table = layer_heights_table(spark.createDataFrame(list(enumerate(DEPTHS)), "idx int, depth double"))
    assert [r["height"] for r in table.orderBy("idx").collect()] == [1, 2, 4]
    data = values()
    got = by_key(reduce_axes(frame(spark, data), ["depth"], depth_min=2.0, operator="integral").table(), ["time", "lat_idx", "lon_idx"], "thetao")
    for (t, y, x), v in got.items():
        own = data[0][TIMES.index(t), :, y, x]
        assert math.isclose(v, np.nansum(own[1:] * np.array([4.0, 2.0])), rel_tol=1e-12)


def test_variables_without_the_axis_pass_through(spark):
    f = frame(spark, flat=True)
    out = reduce_axes(f, ["depth"])
    assert sorted(out.variables) == ["mlotst", "so", "thetao"]
    assert out.table_of("mlotst").count() == f.table_of("mlotst").count()
    # of latitude and depth it has one: weighted by latitude times the first layer's height
    out = reduce_axes(f, ["depth", "latitude"]).table_of("mlotst")
    data = values()[0][:, 0]
    for (t, x), v in by_key(out, ["time", "lon_idx"], "mlotst").items():
        own, w = data[TIMES.index(t), :, x], np.array(LATS)
        ok = ~np.isnan(own)
        assert math.isclose(v, (own[ok] * w[ok]).sum() / w[ok].sum(), rel_tol=1e-12)


def test_errors_and_warnings(spark):
    f = frame(spark)
    with pytest.raises(ValueError):
        reduce_axes(f, ["height"])
    with pytest.raises(ValueError):
        reduce_axes(f, ["depth"], operator="median")
    flat = frame(spark, flat=True).select(["mlotst"])
    with pytest.warns(UserWarning):
        assert reduce_axes(flat, ["depth"]).table().count() == flat.table().count()
    with pytest.raises(ValueError):
        reduce_axes(flat, ["time"], depth_min=0.0)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert reduce_axes(f, [], operator="max").table().count() == f.table().count()
    assert reduce_axes(f, ["time"], operation="max").table().count() > 0
    with pytest.raises(ActionNotFound):
        run_action("extract_everything", f)


def test_weights_that_sum_to_zero_give_null(spark):
    from dataclasses import replace

    f = frame(spark)
    zero = f.table().where("lat_idx = 0").selectExpr("time", "depth_idx", "depth", "lat_idx", "0.0D as latitude", "lon_idx", "longitude", "thetao")
    out = reduce_axes(replace(f, tables=(zero,), axes=f.axes | {"latitude": [0.0, 1.0]}), ["latitude"]).table()
    assert {r["thetao"] for r in out.collect()} == {None}
