"""Sections, curvilinear grids, spectra, hulls, selections and names on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.functions import names
from halocline.operators import sections, select


def test_four_dimensions_of_a_linear_field_are_exact(spark):
    f = spark.createDataFrame([(x, y, z, t, 1.0 * x + 2 * y - 3 * z + 4 * t) for x in range(3) for y in range(3) for z in range(3) for t in range(2)], "i_x int, i_y int, i_z int, i_t int, v double")
    p = spark.createDataFrame([(1, 0.5, 1.25, 1.5, 0.75), (2, 2.0, 2.0, 2.0, 1.0), (3, 5.0, 0.0, 0.0, 0.0)], "id int, x double, y double, z double, t double")
    out = {r["id"]: r["value"] for r in sections.at_points_4d(f, p, "v", {a: (0.0, 1.0) for a in "xyzt"}).collect()}
    assert out[1] == pytest.approx(0.5 + 2.5 - 4.5 + 3)
    assert out[2] == pytest.approx(2 + 4 - 6 + 4)
    assert out[3] is None


def test_curvilinear_grid(spark):
    place = lambda j, i: (i + 0.2 * j, j + 0.1 * i * i)
    g = spark.createDataFrame([(j, i, *place(j, i)) for j in range(6) for i in range(6)], "j int, i int, x double, y double")
    pts, truth = [], {}
    for k, (j, i, p, q) in enumerate([(0, 0, 0.5, 0.5), (3, 2, 0.1, 0.9), (4, 4, 0.7, 0.3)]):
        c = [place(j, i), place(j, i + 1), place(j + 1, i + 1), place(j + 1, i)]
        w = [(1 - p) * (1 - q), p * (1 - q), p * q, (1 - p) * q]
        pts.append((k, sum(a * b[0] for a, b in zip(w, c, strict=True)), sum(a * b[1] for a, b in zip(w, c, strict=True))))
        truth[k] = (j, i, p, q)
    points = spark.createDataFrame([*pts, (9, 50.0, 50.0)], "id int, x double, y double")
    found = sections.relative_positions(g, points, "id", 1.5)
    got = {r["id"]: (r["j"], r["i"], r["p"], r["q"]) for r in found.collect()}
    assert got == {k: (j, i, pytest.approx(p), pytest.approx(q)) for k, (j, i, p, q) in truth.items()}
    values = {r["id"]: r["value"] for r in sections.apply_positions(g.withColumn("v", F.col("x") * 2), found, "id", "v").collect()}
    assert values == {k: pytest.approx(2 * x) for k, x, _ in pts}


def test_hull(spark):
    rng = np.random.default_rng(0)
    inner = [(float(x), float(y)) for x, y in rng.uniform(0.1, 0.9, (200, 2))]
    corners = {(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)}
    out = sections.hull(spark.createDataFrame([*inner, *corners], "x double, y double"), parts=5).collect()
    assert {(r["x"], r["y"]) for r in out} == corners


def test_spectrum_keeps_the_variance(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(8, 12))
    f = spark.createDataFrame([(t, j, i, float(v[j, i] * (t + 1))) for t in range(2) for j in range(8) for i in range(12)], "t int, j int, i int, v double")
    total = {r["t"]: r["p"] for r in sections.spectrum(f, ["t"], "v", 1.0, 1.0).groupBy("t").agg(F.sum("power").alias("p")).collect()}
    assert total == {0: pytest.approx(v.var()), 1: pytest.approx(4 * v.var())}


def test_refined_plane(spark):
    f = spark.createDataFrame([(j, i, 3.0 * j + i) for j in range(3) for i in range(4)], "j int, i int, v double")
    assert all(r["v"] == pytest.approx(3 * r["j"] / 2 + r["i"] / 2) for r in sections.refine(f, "v", 2, 3, 4).collect())


def test_bounds_letters(spark):
    axis = spark.range(10).select(F.col("id").cast("double").alias("lon"))
    ends = lambda *a, **k: tuple(select.index_range(axis, "lon", *a, **k).first())
    assert ends(3.0, 4.0) == (3, 5)
    assert ends(3.0, 4.0, neighbours=True) == (2, 6)
    assert ends(3.0, 5.0, "oc") == (4, 6)
    assert ends(3.2, 3.8) == (None, None)


def test_selection_reaches_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").alias("x"), F.col("id").alias("y")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).filter(select.selector(x=(2, 5, "co"))).select("x")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,2)" in plan
    assert "y" not in plan.split("ReadSchema")[1]


def test_masks_and_axes(spark):
    df = spark.createDataFrame([(0, 1.0, None), (0, 2.0, 3.0)], "t int, a double, b double")
    assert select.squeeze(df, ["t"]).columns == ["a", "b"]
    assert [tuple(r) for r in select.merge_masks(df, ["a", "b"]).collect()] == [(0, None, None), (0, 2.0, 3.0)]
    assert [tuple(r) for r in select.merge_masks(df, ["a", "b"], "min").collect()] == [(0, 1.0, None), (0, 2.0, 3.0)]


def test_names(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "nav_lon double, votemper double, thing double").withMetadata("thing", {"standard_name": "sea_water_salinity_at_u_location"})
    assert [names.find(df, n) for n in ("lon", "temp", "sal", "lat")] == ["nav_lon", "votemper", "thing", None]
    out = names.format_column(df, "votemper", "temp")
    assert out.schema["temp"].metadata["units"] == "degC"
    assert names.axis_type(df, "nav_lon") == "x"
    assert names.order(df) == "x"
    assert names.get(df, "sal", "lon").columns == ["lon", "sal"]
    with pytest.raises(KeyError):
        names.get(df, "ssh")
