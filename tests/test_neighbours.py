"""Thinning by radius, nearest points and shared areas against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from halocline.operators import neighbours, overlaps, points, regrid, thinning


def greedy(x, y, r):
    kept = []
    for i in range(len(x)):
        if all(np.hypot(x[i] - x[k], y[i] - y[k]) >= r for k in kept):
            kept.append(i)
    return kept


@pytest.mark.parametrize("order", ["random", "along a line", "crowded"])
def test_thinning_is_that_of_one_point_after_another(spark, order):
    rng = np.random.default_rng(5)
    x, y = rng.uniform(0, 10, 300), rng.uniform(0, 10, 300)
    if order == "along a line":
        x, y = np.arange(24) * 0.31, np.sin(np.arange(24) * 0.1)
    if order == "crowded":
        x[:200], y[:200] = rng.normal(5, 0.01, 200), rng.normal(5, 0.01, 200)
        x[50:80], y[50:80] = 5.0, 5.0
    z = rng.normal(size=len(x))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(x)), "x": x, "y": y, "z": z})).repartition(3)
    kept = greedy(x, y, 0.8)
    options = {"random": {"tile": 4}, "along a line": {"tile": 8}, "crowded": {"tile": 6, "most": 20}}[order]
    assert sorted(r["id"] for r in thinning.thin_by_radius(df, "id", 0.8, **options).collect()) == kept
    means = {k: pytest.approx(z[np.hypot(x - x[k], y - y[k]) < 0.8 * 0.5].mean()) for k in kept}
    assert {r["id"]: r["z"] for r in thinning.thin_by_radius(df, "id", 0.8, value="z", mean=0.5).collect()} == means
    if order == "random":
        return
    own = {r["id"]: r["z"] for r in thinning.thin_by_radius(df, "id", 0.8, value="z", mean=0.0).collect()}
    assert own == {k: pytest.approx(z[k]) for k in kept}


@pytest.mark.parametrize("depth", [None, 0, 9])
def test_k_nearest(spark, depth):
    """Crowded, repeated and missing places; targets far away; more asked for than there are."""
    rng = np.random.default_rng(6)
    x = np.r_[rng.uniform(-50, 50, 200), rng.normal(3, 0.01, 150), np.full(40, 7.0)]
    y = np.r_[rng.uniform(-50, 50, 200), rng.normal(3, 0.01, 150), np.full(40, -7.0)]
    p = spark.createDataFrame([*[(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], (900, None, 1.0)], "p int, x double, y double").repartition(3)
    at = [(7.0, -7.0), (3.0, 3.0), (1e5, 0.0), *map(tuple, rng.uniform(-60, 60, (30, 2)))]
    t = spark.createDataFrame([*[(i, float(a), float(b)) for i, (a, b) in enumerate(at)], (99, None, 0.0)], "t int, x double, y double")
    got = {}
    for r in neighbours.k_nearest(t, "t", p, "p", 7, depth=depth).collect():
        got.setdefault(r["t"], {})[r["rank"]] = r["p"]
    for i, (a, b) in enumerate(at):
        d = np.hypot(x - a, y - b)
        assert [got[i][k + 1] for k in range(7)] == np.lexsort((np.arange(len(x)), d))[:7].tolist()
    assert 99 not in got
    few = neighbours.k_nearest(t, "t", p.limit(0), "p", 3).collect()
    assert few == []
    assert neighbours.k_nearest(t.filter("t = 1"), "t", p.filter("p < 2"), "p", 5).count() == 2


def test_planes_meet_a_plane(spark):
    rng = np.random.default_rng(9)
    x, y = rng.uniform(0, 10, 200), rng.uniform(0, 10, 200)
    p = spark.createDataFrame(pd.DataFrame({"p": np.arange(200), "x": x, "y": y, "z": 3 * x - y + 1}))
    at = rng.uniform(2, 8, (60, 2))
    t = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(at)], "t int, x double, y double")
    got = {r["t"]: r["value"] for r in neighbours.local_planes(p, "p", t, "t", both=True).collect()}
    near = [np.hypot(x - a, y - b).argmin() for a, b in at]
    on_plane = [got[k] == pytest.approx(3 * a - b + 1) for k, (a, b) in enumerate(at)]
    assert sum(on_plane) > 55
    assert all(ok or got[k] == pytest.approx(3 * x[near[k]] - y[near[k]] + 1) for k, ok in enumerate(on_plane))
    pair = neighbours.local_planes(p.filter("p < 3"), "p", t, "t").collect()
    z = 3 * x - y + 1
    assert [r["value"] for r in pair] == pytest.approx([(z[0] + z[1]) / 2] * 60)
    assert {r["value"] for r in neighbours.local_planes(p.filter("p < 1"), "p", t, "t").collect()} == {None}


def bent(spark, nj, ni, turn, step, x0, y0):
    cells = spark.range(nj * ni).select(F.floor(F.col("id") / ni).cast("int").alias("j"), (F.col("id") % ni).cast("int").alias("i"))
    c, s = float(np.cos(turn)), float(np.sin(turn))
    x = x0 + step * (c * F.col("i") - s * F.col("j")) + 0.02 * F.col("i") * F.col("i")
    y = y0 + step * (s * F.col("i") + c * F.col("j")) + 0.01 * F.col("i") * F.col("j")
    return overlaps.cells_of_mesh(regrid.corners(cells.withColumns({"x": x, "y": y}), nj, ni))


def test_shared_areas_conserve(spark):
    """A fine bent grid inside a coarse one: areas add up, constants stay, totals are conserved."""
    fine, coarse = bent(spark, 8, 9, 0.4, 1.0, 2.0, 1.0), bent(spark, 7, 8, -0.3, 3.1, -8.0, -4.0)
    assert fine.count() == 72 and coarse.count() == 56
    w = overlaps.shared_areas(fine, coarse, 3.0).cache()
    assert {(r["sj"], r["si"], r["tj"], r["ti"]) for r in w.collect()} == {(r["sj"], r["si"], r["tj"], r["ti"]) for r in overlaps.shared_areas(fine, coarse, 0.7).collect()}
    held = w.groupBy("sj", "si").agg(F.sum("area").alias("a")).join(fine.select(F.col("j").alias("sj"), F.col("i").alias("si"), points.area(F.col("corners")).alias("whole")), ["sj", "si"])
    assert held.count() == 72 and all(r["a"] == pytest.approx(r["whole"], rel=1e-9) for r in held.collect())
    field = fine.select("j", "i", (F.col("j") * 3.0 + F.col("i")).alias("v"), F.lit(5.0).alias("one"))
    assert all(r["one"] == pytest.approx(5.0, rel=1e-12) for r in overlaps.regrid(field, [], "one", w).collect())
    total = field.join(fine, ["j", "i"]).agg(F.sum(F.col("v") * points.area(F.col("corners")))).first()[0]
    got = overlaps.regrid(field, [], "v", w, coarse, "conserve").join(coarse, ["j", "i"]).agg(F.sum(F.col("v") * points.area(F.col("corners")))).first()[0]
    assert got == pytest.approx(total, rel=1e-9)
    assert 0 < overlaps.regrid(field.withColumn("v", F.when(F.col("j") > 6, F.col("v"))), [], "v", w).count() < overlaps.regrid(field, [], "v", w).count()
    with pytest.raises(ValueError, match="conserve"):
        overlaps.regrid(field, [], "v", w, method="conserve")


def test_clipping(spark):
    square = points.polygon([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])
    cases = [([(1, 1), (3, 1), (3, 3), (1, 3)], 1.0), ([(0, 0), (2, 0), (2, 2), (0, 2)], 4.0), ([(5, 5), (6, 5), (6, 6)], 0.0), ([(-1, 1), (1, -1), (3, 1), (1, 3)], 4.0), ([(2, 0), (3, 0), (3, 1), (2, 1)], 0.0), ([(-9, -9), (9, -9), (0, 90)], 4.0)]
    for corners, truth in cases:
        other = points.polygon([tuple(map(float, v)) for v in corners])
        got = spark.range(1).select(overlaps.shared_area(other, square).alias("a"), overlaps.shared_area(square, other).alias("b")).first()
        assert (got["a"], got["b"]) == (pytest.approx(truth), pytest.approx(truth))
