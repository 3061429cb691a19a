"""Operators on small inputs with known answers."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.operators import grid, interp, islands, kriging, points, profiles, stats, tide, windows
from halocline.sources import files
from halocline.streaming import accumulate


def test_accumulator_against_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), None if i % 7 == 0 else float(a), None if i % 5 == 0 else float(b)) for i, (k, a, b) in enumerate(zip(rng.integers(0, 3, 300), rng.normal(size=300), rng.normal(size=300), strict=True))]
    df = spark.createDataFrame(rows, "k int, x double, y double")
    halves = [stats.accumulate(df.filter(F.col("k") >= 0).filter(c), ["k"], "x", "y", [-1.0, 0.0, 1.0]) for c in ("x > 0 or x is null", "x <= 0")]
    merged = stats.statistics(stats.merge(halves[0].unionByName(halves[1]), ["k"], bins=2), ["k"])
    for r in merged.collect():
        a, b = np.array([(x, y) for k, x, y in rows if k == r["k"] and x is not None and y is not None]).T
        assert r["count"] == len(a)
        assert r["mean"] == pytest.approx(a.mean())
        assert r["std"] == pytest.approx(a.std())
        assert r["bias"] == pytest.approx((b - a).mean())
        assert r["crms"] == pytest.approx((b - a).std())
        assert r["corr"] == pytest.approx(np.corrcoef(a, b)[0, 1])
        assert r["hist"] == [int(((a >= -1) & (a < 0)).sum()), int(((a >= 0) & (a < 1)).sum())]


def test_a_group_without_values(spark):
    df = spark.createDataFrame([(1, None, 2.0), (1, None, None)], "k int, x double, y double")
    r = stats.statistics(stats.accumulate(df, ["k"], "x", "y"), ["k"]).first()
    assert (r["avail"], r["count"], r["mean"], r["corr"]) == (0.0, 0, None, None)


def test_eroded_coast_fills_ring_by_ring(spark):
    f = spark.createDataFrame([(j, i, 1.0 if i == 0 else None) for j in range(3) for i in range(5)], "j int, i int, v double")
    out = grid.erode(f, [], "v", F.col("i") < 4, rounds=2).collect()
    assert {r["i"]: r["v"] for r in out} == {0: 1.0, 1: 1.0, 2: 1.0, 3: None, 4: None}


def test_correlation_probability(spark):
    df = spark.createDataFrame([(0.0, 30), (0.5, 30), (0.999, 30)], "r double, n int")
    p = [r["probability"] for r in stats.correlation_probability(df, "r", "n").collect()]
    assert p[0] == pytest.approx(0, abs=1e-6)
    assert 99 < p[1] < 100
    assert p[2] == pytest.approx(100, abs=1e-6)


def _axis(spark, values):
    return spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "k int, x int, v double").withColumn("xd", F.col("x").cast("double"))


def test_filter_keeps_a_constant(spark):
    out = windows.filter1d(_axis(spark, [1.0, 1.0, None, 1.0, 1.0]), ["k"], "x", "v", windows.shapiro(), "minimal").orderBy("x").collect()
    assert [r["filtered"] for r in out] == [1.0] * 5
    flat = spark.createDataFrame([(j, i, None if 3 <= j < 6 and 3 <= i < 6 else 1.0) for j in range(10) for i in range(10)], "j int, i int, v double")
    assert {r["filtered"] for r in grid.filter2d(flat, [], "v", grid.shapiro2d()).collect()} == {1.0, None}


def test_gaps_are_filled_up_to_a_length(spark):
    df = _axis(spark, [None, 1.0, None, 3.0, None, None, 6.0, None])
    out = windows.fill_gaps(df, ["k"], "x", "v", F.col("xd"), 1).orderBy("x").collect()
    assert [r["filled"] for r in out] == [None, 1.0, 2.0, 3.0, None, None, 6.0, None]


@pytest.mark.parametrize("method", ["linear", "hermite"])
def test_interpolation_of_a_line_is_exact(spark, method):
    src = spark.createDataFrame([(0, float(x), 2.0 * x + 1) for x in range(6)], "k int, x double, v double")
    dst = spark.createDataFrame([(0, -1.0), (0, 0.0), (0, 2.5), (0, 5.0), (0, 6.0)], "k int, x double")
    out = {r["x"]: r["value"] for r in interp.interp1d(src, dst, ["k"], "x", "v", method).collect()}
    assert out == {-1.0: None, 0.0: 1.0, 2.5: 6.0, 5.0: 11.0, 6.0: None}


def test_interpolation_next_to_a_null(spark):
    src = spark.createDataFrame([(0, 0.0, 1.0), (0, 1.0, None), (0, 2.0, 3.0)], "k int, x double, v double")
    dst = spark.createDataFrame([(0, x) for x in (0.0, 0.5, 1.0, 2.0, 3.0)], "k int, x double")
    out = {r["x"]: r["value"] for r in interp.interp1d(src, dst, ["k"], "x", "v", extrapolate="both").collect()}
    assert out == {0.0: 1.0, 0.5: None, 1.0: None, 2.0: 3.0, 3.0: 3.0}


def test_conservative_remap_keeps_the_sum(spark):
    src = spark.createDataFrame([(0, float(i), float(i + 1), float(i * i)) for i in range(10)], "k int, lo double, hi double, v double")
    dst = spark.createDataFrame([(0, n, n * 2.5, n * 2.5 + 2.5) for n in range(4)], "k int, n int, d_lo double, d_hi double")
    out = interp.cell_average(src, dst, ["k"], ["n"], "v", 2.5, conserve=True).collect()
    assert sum(r["value"] for r in out) == pytest.approx(sum(i * i for i in range(10)))


def test_bilinear_of_a_plane_is_exact(spark):
    f = spark.createDataFrame([(j, i, 2.0 * i - j) for j in range(5) for i in range(6)], "j int, i int, v double")
    p = spark.createDataFrame([(1, 1.25, 2.5), (2, 0.0, 0.0), (3, 9.0, 9.0)], "id int, x double, y double")
    out = {r["id"]: r["value"] for r in grid.at_points(f, p, [], "v", 0.0, 1.0, 0.0, 1.0).collect()}
    assert out[1] == pytest.approx(0.0)
    assert out[2] == 0.0
    assert out[3] is None


def test_coast_bits(spark):
    land = {(1, 2), (0, 0)}
    f = spark.createDataFrame([(j, i, (j, i) in land) for j in range(3) for i in range(3)], "j int, i int, l boolean")
    code = {(r["j"], r["i"]): r["code"] for r in grid.coast(f, [], F.col("l")).collect()}
    assert code[1, 1] == 2
    assert code[1, 2] == 0
    assert code[2, 0] == 0
    assert code[2, 1] == 32


def test_lakes_meet_at_sides_only(spark):
    water = ["110", "001", "011"]
    f = spark.createDataFrame([(j, i, c == "1") for j, row in enumerate(water) for i, c in enumerate(row)], "j int, i int, w boolean")
    found = islands.label(f, [], F.col("w"))
    assert sorted((r["j"], r["i"], r["lake_j"], r["lake_i"], r["cells"]) for r in found.collect()) == [(0, 0, 0, 0, 2), (0, 1, 0, 0, 2), (1, 2, 1, 2, 3), (2, 1, 1, 2, 3), (2, 2, 1, 2, 3)]
    assert islands.ocean(found, []).count() == 3


def test_nearest_searches_on(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0)], "p int, lon double, lat double")
    t = spark.createDataFrame([(7, 1.0, 1.0), (8, -30.0, 0.0)], "t int, lon double, lat double")
    out = {r["p"]: (r["nearest"], r["distance"]) for r in points.nearest(p, "p", t, "t", 0.5, geo=False).collect()}
    assert out == {1: (7, pytest.approx(math.sqrt(2))), 2: (7, pytest.approx(math.hypot(49, 49)))}


def test_duplicates(spark):
    t = datetime(2020, 1, 1)
    rows = [(1, "a", t, False), (2, "A ", t, False), (3, "a", t + timedelta(hours=6), True), (4, "a", t + timedelta(hours=30), True), (5, "b", t, False)]
    casts = spark.createDataFrame(rows, "id int, p string, t timestamp_ntz, bad boolean").withColumn("lat", F.lit(1))
    out = {r["id"]: r["duplicate"] for r in points.duplicates(casts, "id", "p", "t", "bad", ["lat"]).collect()}
    assert out == {1: False, 2: True, 3: True, 4: False, 5: False}


def test_mixed_layer(spark):
    df = spark.createDataFrame([(1, -z * 10.0, 20.0 if z < 3 else 15.0) for z in range(6)] + [(2, -z * 10.0, 20.0) for z in range(3)], "p int, depth double, t double")
    out = {r["p"]: r["mld"] for r in profiles.mixed_layer(df, ["p"], "depth", "t", -0.2).collect()}
    assert out == {1: pytest.approx(20.4), 2: 20.0}


def test_tide_filters_take_the_tide(spark):
    t0 = datetime(2024, 1, 1)
    wave = [(0, t0 + timedelta(hours=h), 5 + math.sin(2 * math.pi * h / 12.4206)) for h in range(200)]
    df = spark.createDataFrame(wave, "k int, t timestamp_ntz, v double")
    for weights in (tide.demerliac(), tide.godin()):
        assert len(weights) == 71
        out = [r["filtered"] for r in tide.tide_filter(df, ["k"], "t", "v", weights).orderBy("t").collect()]
        assert out[34] is None
        assert all(abs(x - 5) < 0.02 for x in out[35:-35])


def test_kriging_meets_its_points(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(y), float(math.sin(x) + y)) for i, (x, y) in enumerate(rng.uniform(0, 4, (150, 2)))]
    p = spark.createDataFrame(rows, "id int, x double, y double, z double")
    out = {r["id"]: r for r in kriging.krige(p, p.select("id", "x", "y"), "id", 1.0, "exponential", 0.0, 1.0, 2.0, most=40).collect()}
    assert len(out) == 150
    assert all(abs(out[i]["value"] - z) < 1e-6 and out[i]["error"] < 1e-3 for i, _, _, z in rows)


def test_variogram_fit(spark):
    import pandas as pd

    d = np.linspace(0.5, 10, 20)
    binned = pd.DataFrame({"distance": d, "gamma": kriging.model("exponential", d, 0.0, 2.0, 5.0), "pairs": 1})
    nugget, sill, reach = kriging.fit_variogram(binned)
    assert (nugget, sill, reach) == (pytest.approx(0, abs=0.05), pytest.approx(2, rel=0.05), pytest.approx(5, rel=0.1))


def test_best_estimate_over_three_batches(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(b, t0 + timedelta(days=b + k)) for b in range(3) for k in range(3)]
    out = files.best_estimate(spark.createDataFrame(rows, "b int, t timestamp_ntz"), "b", "t", [])
    assert sorted((r["b"], (r["t"] - t0).days) for r in out.collect()) == [(0, 0), (1, 1), (2, 2), (2, 3), (2, 4)]


def test_text_sources(spark, tmp_path):
    (tmp_path / "s.txt").write_text("Brest le Conquet              48.36 -4.78 4.1\n\n")
    assert files.read(spark, str(tmp_path / "s.txt"), "stations").collect()[0]["lat"] == 48.36
    (tmp_path / "n.txt").write_text("&grid\n NX = 10,\n name = 'a b' ! x\n/\n")
    assert {(r["name"], r["key"]): r["value"] for r in files.namelist(spark, str(tmp_path / "n.txt")).collect()} == {("grid", "nx"): "10", ("grid", "name"): "a b"}
    assert files.dated_names("f_%Y%m.nc", datetime(2023, 12, 1), datetime(2024, 1, 31)) == ["f_202312.nc", "f_202401.nc"]
    assert files.parse_size("2 Kio") == 2048


def test_stream_adds_up(spark, tmp_path):
    src = str(tmp_path / "in")
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("x"))
    df.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    accumulate.accumulate_to(stream, str(tmp_path / "out"), ["k"], "x", None, str(tmp_path / "check")).awaitTermination(60)
    sums = spark.read.parquet(str(tmp_path / "out"))
    assert sums.select("batch").distinct().count() > 1
    total = {r["k"]: r["mean"] for r in stats.statistics(stats.merge(sums, ["k"]), ["k"]).collect()}
    assert total == {k: pytest.approx(np.arange(k, 100, 3).mean()) for k in range(3)}


def test_window_means_of_a_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(datetime(2024, 1, 1, h, 30), "a", float(h)) for h in range(5)]
    df = spark.createDataFrame(rows, "ts timestamp, k string, v double")
    df.write.parquet(src)
    stream = accumulate.window_means(spark.readStream.schema(df.schema).parquet(src), "ts", ["k"], "v")
    query = stream.writeStream.format("memory").queryName("means").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["mean"] for r in spark.table("means").collect()) == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_weights_of_filters():
    """Numbers worked out by hand from the definitions."""
    from halocline.operators import windows

    assert grid.shapiro2d() == [[0.5, 1.0, 0.5], [1.0, 2.0, 1.0], [0.5, 1.0, 0.5]]
    assert grid.shapiro2d(0.25)[1][1] == 2.0
    assert windows.gaussian(9)[0] == pytest.approx(0.820754808298268)
    assert windows.gaussian(3) == pytest.approx([0.894839316814370, 1.0, 0.894839316814370])
    assert grid.gaussian2d(5)[2] == pytest.approx([0.000123409804087, 0.105399224561864, 1.0, 0.105399224561864, 0.000123409804087], rel=1e-9)
    assert grid.gaussian2d(5)[0][0] == 0.0
    assert len(grid.gaussian2d(7, 3)) == 3


def test_moments_do_not_cancel(spark):
    df = spark.range(1000).select((F.col("id") % 2).cast("int").alias("k"), (1e9 + F.col("id") % 7).alias("x"), (1e9 + F.col("id") % 5).alias("y"))
    whole = stats.statistics(stats.accumulate(df, [], "x", "y"), []).first()
    halves = stats.accumulate(df, ["k"], "x", "y").drop("k")
    merged = stats.statistics(stats.merge(halves, []), []).first()
    rows = df.toPandas()
    assert merged["std"] == pytest.approx(rows["x"].std(ddof=0), rel=1e-9)
    assert merged["crms"] == pytest.approx((rows["y"] - rows["x"]).std(ddof=0), rel=1e-9)
    assert all(merged[c] == pytest.approx(whole[c], rel=1e-14) for c in ("mean", "mean_y", "rms", "bias"))
    # squares of deviations lose what their mean, of nine digits, takes; around a rough mean they lose nothing
    assert all(merged[c] == pytest.approx(whole[c], rel=1e-7) for c in ("std", "std_y"))
    assert merged["bias"] == pytest.approx((rows["y"] - 1e9 - (rows["x"] - 1e9)).mean(), rel=1e-12)
    # without a rough mean the product of two variables keeps as many digits as their means have to spare
    exact = float(np.corrcoef(rows["x"] - 1e9, rows["y"] - 1e9)[0, 1])
    assert merged["corr"] == pytest.approx(exact, abs=1e-6) and whole["corr"] == pytest.approx(exact, abs=1e-6)
    near = stats.accumulate(df, ["k"], "x", "y", around=(1e9, 1e9)).drop("k")
    for found in (near, near.union(near)):
        got = stats.statistics(stats.merge(found, []), []).first()
        assert got["corr"] == pytest.approx(exact, abs=1e-9) and got["std"] == pytest.approx((rows["x"] - 1e9).std(ddof=0), rel=1e-9)


def test_long_filters_keep_the_mask(spark):
    df = spark.range(200).select(F.lit(0).alias("g"), "id", F.when(F.col("id") % 10 != 3, F.col("id").cast("double")).alias("v"))
    from halocline.operators import windows

    got = {r["id"]: r["f"] for r in windows.filter1d(df, ["g"], "id", "v", [1.0] * 71, "minimal", "f").collect()}
    for i in (0, 50, 199):
        near = [k for k in range(max(0, i - 35), min(200, i + 36)) if k % 10 != 3]
        assert got[i] == pytest.approx(sum(near) / len(near))


@pytest.mark.parametrize("chunk", [3, 50, 1000])
def test_long_series_in_chunks(spark, chunk):
    df = spark.range(120).select("id", F.when(F.col("id") % 9 != 4, F.sin(F.col("id").cast("double"))).alias("v"))
    whole = windows.filter1d(df, [], "id", "v", windows.hamming(7), "minimal").orderBy("id").collect()
    parts = windows.filter_long(df, [], "id", "v", windows.hamming(7), "minimal", chunk).orderBy("id").collect()
    assert [r["id"] for r in parts] == list(range(120))
    assert [r["filtered"] for r in parts] == pytest.approx([r["filtered"] for r in whole])


def test_units_of_other_kinds_are_refused(spark):
    from halocline.functions.units import convert, parse_unit

    assert parse_unit("kg m-3") == ({"kg": 1, "m": -3}, 1.0, 0.0)
    assert parse_unit("W/m2")[0] == {"W": 1, "m": -2}
    assert spark.range(1).select(convert(F.lit(36.0), "km/h", "m s-1").alias("v")).first()["v"] == pytest.approx(10.0)
    with pytest.raises(ValueError, match="kinds"):
        convert(F.lit(1.0), "kg m-3", "m")
    with pytest.raises(ValueError, match="no unit"):
        parse_unit("furlong")


@pytest.mark.parametrize("length", [1, 2, 9, 100])
def test_running_average_shrinks_at_the_ends(spark, length):
    values = [None if i % 7 == 3 else float(i * i % 11) for i in range(25)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double").withColumn("g", F.lit("a"))
    for keep in (True, False):
        got = {r["i"]: r["average"] for r in windows.running_average(df, ["g"], "i", "v", length, keep_nulls=keep).collect()}
        for i, v in enumerate(values):
            reach = min(i, 24 - i, length // 2)
            near = [x for x in values[i - reach : i + reach + 1] if x is not None]
            assert got[i] == (pytest.approx(sum(near) / len(near)) if near and (v is not None or not keep) else None)
