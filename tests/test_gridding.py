"""Nearest neighbours on the sphere, scattered gridding, kriging, splines and masks, against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from halocline.operators import kriging, points, regrid, scatter, sections, splines
from halocline.sources.bank import Bank


def great_circle(a, b):
    lo1, la1, lo2, la2 = map(math.radians, (*a, *b))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371006.0 * math.asin(min(1.0, math.sqrt(h)))


def test_nearest_knows_poles_and_the_date_line(spark):
    rng = np.random.default_rng(3)
    t = [(k, float(lo), float(la)) for k, (lo, la) in enumerate(zip(rng.uniform(-180, 180, 60), np.degrees(np.arcsin(rng.uniform(-1, 1, 60))), strict=True))]
    p = [(k, float(lo), float(la)) for k, (lo, la) in enumerate([(179.9, 10.0), (-179.9, 10.0), (0.0, 90.0), (77.0, -90.0), (10.0, 89.5), *zip(rng.uniform(-180, 180, 40), rng.uniform(-89, 89, 40), strict=True)])]
    got = points.nearest(spark.createDataFrame(p, "p int, lon double, lat double"), "p", spark.createDataFrame([*t, (99, None, 1.0)], "t int, lon double, lat double"), "t", 3.0).collect()
    best = {k: min((great_circle((lo, la), (a, b)), n) for n, a, b in t) for k, lo, la in p}
    assert {r["p"]: r["nearest"] for r in got} == {k: n for k, (_, n) in best.items()}
    assert all(r["distance"] == pytest.approx(best[r["p"]][0], rel=1e-9) for r in got)


def triangles(x, y, tx, ty):
    """Corners, -1 outside the hull, and weights, by all points for every target."""
    far = 1e4 * (np.ptp(x) + np.ptp(y) + np.ptp(tx) + np.ptp(ty))
    tri, w, *_ = scatter.enclosing(x[None, :] - tx[:, None], y[None, :] - ty[:, None], far)
    tri[(tri >= len(x)).any(1)] = -1
    return tri, w


def test_triangles_are_those_of_empty_circles():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=40), rng.normal(size=40)
    tx, ty = rng.normal(size=200), rng.normal(size=200)
    tri, w = triangles(x, y, tx, ty)
    inside = tri[:, 0] >= 0
    assert 80 < inside.sum() < 200
    for t, k in zip(tri[inside], np.flatnonzero(inside), strict=True):
        a = np.array([[2 * (x[t[i]] - x[t[0]]), 2 * (y[t[i]] - y[t[0]])] for i in (1, 2)])
        b = np.array([x[t[i]] ** 2 + y[t[i]] ** 2 - x[t[0]] ** 2 - y[t[0]] ** 2 for i in (1, 2)])
        cx, cy = np.linalg.solve(a, b)
        r = np.hypot(x[t[0]] - cx, y[t[0]] - cy)
        assert (np.hypot(x - cx, y - cy) >= r * (1 - 1e-9)).all()
        assert (w[k] @ x[t], w[k] @ y[t]) == (pytest.approx(tx[k]), pytest.approx(ty[k]))


@pytest.mark.parametrize(("near", "more"), [(3, 1), (8, 4), (24, 8), (500, 8)])
def test_linear_is_the_same_however_few_points_are_met(spark, near, more):
    rng = np.random.default_rng(2)
    x, y = rng.uniform(0, 5, 120), rng.uniform(0, 5, 120)
    z, at = np.sin(x) + y, rng.uniform(-0.5, 5.5, (80, 2))
    tri, w = triangles(x, y, at[:, 0], at[:, 1])
    truth = [None if t[0] < 0 else float(v @ z[t]) for t, v in zip(tri, w, strict=True)]
    p = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": z}))
    t = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(at)] + [(99, None, 1.0)], "id int, x double, y double")
    got = {r["id"]: r["value"] for r in scatter.linear(p, t, "id", near, more=more).collect()}
    assert got.pop(99) is None
    assert got == {k: v if v is None else pytest.approx(v) for k, v in enumerate(truth)}


def test_thin_triangles_of_a_crowded_set(spark):
    """Most points in one small place and a sparse rim: triangles at the hull are thin, their circles wide."""
    rng = np.random.default_rng(8)
    a = np.linspace(0, 2 * np.pi, 40, endpoint=False) + rng.uniform(0, 0.1, 40)
    x = np.r_[rng.normal(0.3, 0.001, 1500), 50 * np.cos(a), rng.uniform(-20, 20, 30)]
    y = np.r_[rng.normal(-0.2, 0.001, 1500), 50 * np.sin(a), rng.uniform(-20, 20, 30)]
    z, at = x - 2 * y + np.cos(x), np.r_[rng.uniform(-45, 45, (60, 2)), rng.normal([0.3, -0.2], 0.002, (40, 2))]
    tri, w = triangles(x, y, at[:, 0], at[:, 1])
    truth = {k: None if t[0] < 0 else pytest.approx(float(v @ z[t]), rel=1e-6, abs=1e-6) for k, (t, v) in enumerate(zip(tri, w, strict=True))}
    p = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": z}))
    t = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(at)], "id int, x double, y double")
    assert {r["id"]: r["value"] for r in scatter.linear(p, t, "id").collect()} == truth


def test_kriging_of_crowded_places(spark):
    """A third of all points in one small place, and many at one point: systems stay small, and estimates meet the points."""
    rng = np.random.default_rng(4)
    p = [(float(a), float(b), float(a + b)) for a, b in rng.uniform(0, 10, (200, 2))] + [(float(a), float(b), float(a + b)) for a, b in rng.uniform(5, 5.01, (100, 2))] + [(1.0, 1.0, 2.0)] * 500
    df = spark.createDataFrame(p, "x double, y double, z double")
    t = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.005, 5.005), (3, 7.3, 2.1)], "id int, x double, y double")
    got = {r["id"]: r for r in kriging.krige(df, t, "id", 10.0, "linear", 0.0, 1.0, 20.0, most=60).collect()}
    assert got[1]["value"] == pytest.approx(2.0, abs=1e-6)
    assert got[2]["value"] == pytest.approx(10.01, abs=0.05)
    assert got[3]["value"] == pytest.approx(9.4, abs=0.5)


@pytest.mark.parametrize(("most", "clouds", "mean"), [(1000, 4, None), (40, 1, None), (40, 3, None), (25, 4, 2.0)])
def test_kriging_from_clouds(spark, most, clouds, mean):
    """By hand: the same clouds, one system each, blended by 1 / variance^2. Points of a grid, repeated ones, errors."""
    from halocline.operators.cut import Steps

    rng = np.random.default_rng(11)
    x, y = np.r_[np.repeat(np.arange(10.0), 8), rng.uniform(0, 9, 40)], np.r_[np.tile(np.arange(8.0), 10), rng.uniform(0, 7, 40)]
    z, e = np.sin(x) + 0.3 * y, rng.uniform(0, 0.4, 120)
    p = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "z": z, "e": e}))
    at = rng.uniform(0, 8, (30, 2))
    t = spark.createDataFrame([*[(k, float(a), float(b)) for k, (a, b) in enumerate(at)], (99, None, 0.0)], "id int, x double, y double")
    got = {r["id"]: (r["value"], r["error"]) for r in kriging.krige_clouds(p.union(p), t, "id", "spherical", 0.1, 1.5, 6.0, most, clouds, error="e", mean=mean).collect()}
    assert got.pop(99) == (None, None)
    parts = kriging.split_clouds(p, most, Steps(spark, "test")).toPandas()
    sizes = parts.groupby("cloud").size()
    assert sizes.sum() == 120 and sizes.max() <= most and sizes.min() >= min(most, 120) // 3
    cloud = [g for _, g in parts.groupby("cloud")]
    centres = np.array([(g["x"].mean(), g["y"].mean()) for g in cloud])

    def gamma(h):
        r = h / 6.0
        return np.where(h > 0, 0.1 + 1.4 * np.where(r < 1, 1.5 * r - 0.5 * r**3, 1.0), 0.0)

    for k, (a, b) in enumerate(at):
        top = bottom = 0.0
        for i in np.argsort(np.hypot(centres[:, 0] - a, centres[:, 1] - b))[:clouds]:
            g = cloud[i]
            d = gamma(np.hypot(g["x"].to_numpy()[:, None] - g["x"].to_numpy(), g["y"].to_numpy()[:, None] - g["y"].to_numpy()))
            d0, n, zz = gamma(np.hypot(g["x"] - a, g["y"] - b).to_numpy()), len(g), g["z"].to_numpy()
            err = np.diag(g["e"].to_numpy() ** 2)
            if mean is None:
                m = np.block([[d - err, np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
                w = np.linalg.inv(m) @ np.r_[d0, 1.0]
                v, s = w[:n] @ zz, w @ np.r_[d0, 1.0]
            else:
                w = np.linalg.inv(1.5 - d + err) @ (1.5 - d0)
                v, s = mean + w @ (zz - mean), 1.5 - w @ (1.5 - d0)
            top, bottom = top + v / s**2, bottom + 1 / s**2
        assert got[k] == (pytest.approx(top / bottom, rel=1e-6), pytest.approx(bottom**-0.25, rel=1e-6))


def test_simple_kriging_falls_back_to_the_mean(spark):
    df = spark.createDataFrame([(0.0, 0.0, 3.0), (1.0, 0.0, 5.0)], "x double, y double, z double")
    t = spark.createDataFrame([(1, 0.0, 0.0), (2, 40.0, 0.0)], "id int, x double, y double")
    got = {r["id"]: (r["value"], r["error"]) for r in kriging.krige(df, t, "id", 100.0, "exponential", 0.0, 2.0, 3.0, mean=10.0).collect()}
    assert got[1] == (pytest.approx(3.0), pytest.approx(0.0, abs=1e-6))
    assert got[2] == (pytest.approx(10.0, abs=1e-3), pytest.approx(math.sqrt(2.0), abs=1e-3))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9])
def test_spline_meets_nodes_and_cubics(n):
    x = np.array([0.0, 0.7, 1.1, 2.9, 3.0, 4.4, 6.0, 6.1, 9.0])[:n]
    y = 1 + x - 0.2 * x**2 + (0.05 * x**3 if n > 3 else 0)
    if n == 2:
        y = 1 + x
    assert splines.through(x, y, x) == pytest.approx(y)
    at = np.linspace(x[0], x[-1], 23)
    truth = 1 + at - 0.2 * at**2 + (0.05 * at**3 if n > 3 else 0)
    assert splines.through(x, y, at) == pytest.approx(1 + at if n <= 2 else truth)
    assert np.isnan(splines.through(x, y, np.array([x[0] - 1, x[-1] + 1]))).all()


def test_area_of_a_polygon_in_boxes(spark):
    triangle = points.polygon([(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)])
    boxes = [(0, 0, 1, 1, 1.0), (1, 1, 3, 3, 2.0), (3, 3, 4, 4, 0.0), (-5, -5, 9, 9, 8.0), (2, 0, 4, 2, 2.0)]
    df = spark.createDataFrame([tuple(map(float, b)) for b in boxes], "a double, b double, c double, d double, truth double")
    for r in df.withColumn("got", points.polygon_area_in(triangle, F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect():
        assert r["got"] == pytest.approx(r["truth"])


def test_best_method():
    assert regrid.best_method(1.0, 2.0) == "average"
    assert regrid.best_method(1.0, 1.5) == "bilinear"


def test_bank_refuses_a_taken_name(spark, tmp_path):
    bank = Bank(spark, str(tmp_path / "bank"))
    p = spark.createDataFrame([(0.0, 0.0, 1.0), (2.0, 0.0, 1.0), (2.0, 2.0, 1.0), (0.0, 2.0, 1.0)], "x double, y double, z double")
    bank.add(p, "low")
    with pytest.raises(ValueError, match="low"):
        bank.add(p, "low")
    bank.add(p.filter("x > 0"), "low", force=True)
    assert bank.load("low").count() == 2
    bank.add(spark.createDataFrame([(1.0, 1.0, 5.0), (9.0, 9.0, 5.0)], "x double, y double, z double"), "inner")
    bank.add(p, "top")
    assert sorted((r["id"], r["z"]) for r in bank.merged(["inner", "top"], opaque=["top"]).collect()) == [("inner", 5.0), *[("top", 1.0)] * 4]


def test_hull_of_one_batch_and_many(spark):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(3000, 2)), columns=["x", "y"])).repartition(9)
    few = {(r["x"], r["y"]) for r in sections.hull(df).collect()}
    assert few == {(r["x"], r["y"]) for r in sections.hull(df.coalesce(1), parts=1).collect()}
