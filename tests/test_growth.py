"""Work that must not grow faster than its input, and what these forms must keep."""

import math

import pytest
from pyspark.sql import functions as F

from halocline.operators import coast, cut, interp, kriging, points, scatter, stats
from halocline.plans import catalog, inputs


def test_correlation_probability_of_many_values(spark):
    """With 10^8 values the density is far narrower than the steps that 2000 trapezoids of a right angle take."""
    n = 10**8
    rows = [(z / math.sqrt(n), n) for z in (0.5, 1.0, 2.0)] + [(1.0, 10), (0.6, 5), (-0.6, 5), (0.6, 4)]
    df = spark.createDataFrame(rows, "r double, n long")
    got = [r["probability"] for r in stats.correlation_probability(df, "r", "n").collect()]
    want = [100 * math.erf(z / math.sqrt(2)) for z in (0.5, 1.0, 2.0)] + [100.0] + [200 / math.pi * math.asin(0.6)] * 2
    assert got[:-1] == pytest.approx(want, abs=1e-5)
    assert got[-1] is None


def _heaps(spark):
    """4,000 points at seven places: 8 million pairs, but 28 of places."""
    at = (F.col("id") * F.col("id") % 7).cast("double")
    return spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 7 * 1.5).alias("x"), (F.col("id") % 7 % 3 * 1.0).alias("y"), (at + F.col("id") / 500).alias("z"))


def _plain_pairs(spark):
    import numpy as np

    rows = np.array([(r["x"], r["y"], r["z"]) for r in _heaps(spark).collect()])
    i, j = np.triu_indices(len(rows), 1)
    d = np.sqrt((rows[i, 0] - rows[j, 0]) ** 2 + (rows[i, 1] - rows[j, 1]) ** 2)
    return d, (rows[i, 2] - rows[j, 2]) ** 2 / 2


def test_variogram_counts_pairs_by_places(spark):
    pairs = kriging._pairs(_heaps(spark), 5.0, "x", "y", "z")
    assert pairs.count() <= 28
    d, g = _plain_pairs(spark)
    for r in kriging.variogram(_heaps(spark), "k", 2.0, 5.0).collect():
        here = (d < 5) & (d // 2 == r["bin"])
        assert r["pairs"] == here.sum()
        assert (r["distance"], r["gamma"]) == pytest.approx((d[here].mean(), g[here].mean()), rel=1e-9)


def test_equal_counts_have_exact_edges(spark):
    import numpy as np

    d, g = _plain_pairs(spark)
    d, g = d[d < 5], g[d < 5]
    edges = [np.sort(d)[math.ceil(k * len(d) / 5) - 1] for k in range(1, 5)]
    bins = np.searchsorted(edges, d, "left")
    got = {r["bin"]: r for r in kriging.equal_count_bins(_heaps(spark), "k", 5.0, 5, accuracy=4).collect()}
    assert got.keys() == set(bins.tolist())
    for b, r in got.items():
        assert r["pairs"] == (bins == b).sum()
        assert (r["distance"], r["gamma"]) == pytest.approx((d[bins == b].mean(), g[bins == b].mean()), rel=1e-9)


def test_nearest_asks_once_a_place(spark, monkeypatch):
    """3,000 points and 3,000 targets at a few places each: the steps hold places, not points."""
    at = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 5 * 10.0).alias("lon"), (F.col("id") % 3 * 10.0).alias("lat"))
    to = spark.range(3000).select((3000 - F.col("id")).alias("t"), (F.col("id") % 4 * 10.0 + 1).alias("lon"), F.lit(10.0).alias("lat"))
    most = []
    written = cut.Steps.write
    monkeypatch.setattr(cut.Steps, "write", lambda self, df: (lambda out: most.append(out.count()) or out)(written(self, df)))
    for geo in (True, False):
        got = points.nearest(at, "k", to, "t", 5.0, geo=geo).collect()
        assert len(got) == 3000
        assert all(r["nearest"] == {0: 4, 1: 3, 2: 2, 3: 1, 4: 1}[r["k"] % 5] for r in got)
    assert max(most) <= 15


def test_nearest_begins_with_small_cells(spark):
    """4,000 targets in one cell of the given size: the pairs that meet stay in proportion to the points."""
    place = lambda m: ((F.col("id") * m) % 997 / 997.0)
    at = spark.range(500).select(F.col("id").alias("k"), place(31).alias("x"), place(57).alias("y"))
    to = spark.range(4000).select(F.col("id").alias("t"), (place(73) + F.col("id") * 1e-7).alias("x"), place(91).alias("y"))
    got = {r["k"]: r["nearest"] for r in points.nearest(at, "k", to, "t", 100.0, "x", "y", geo=False).collect()}
    rows = [(r["t"], r["x"], r["y"]) for r in to.collect()]
    for r in at.filter("k % 50 = 0").collect():
        assert got[r["k"]] == min(rows, key=lambda v: (math.sqrt((v[1] - r["x"]) ** 2 + (v[2] - r["y"]) ** 2), v[0]))[0]


def test_spacing_counts_lone_points_by_their_squares(spark):
    rows = [(0.0, 0.0), (0.1, 0.0), (0.3, 0.0), (0.9, 0.9), (2.95, 0.9), (50.0, 50.0), (0.1, 0.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, x double, y double")
    near = []
    places = sorted(set(rows))
    for a in places:
        inside = [b for b in places if b != a and all(abs(math.floor(p) - math.floor(q)) <= 1 for p, q in zip(a, b, strict=True))]
        near += [min(math.dist(a, b) for b in inside)] if inside else []
    want = sorted(near)[(len(near) + 1) // 2 - 1]
    assert scatter.spacing(df, "k", 1.0).collect()[0]["spacing"] == pytest.approx(want, abs=1e-12)
    assert scatter.spacing(df.limit(1), "k", 1.0).collect()[0]["spacing"] is None


def test_linear_asks_once_a_place(spark, monkeypatch):
    src = spark.createDataFrame([(0.0, 0.0, 0.0), (4.0, 0.0, 4.0), (0.0, 4.0, 8.0), (4.0, 4.0, 12.0), (2.0, 1.5, 5.0)], "x double, y double, z double")
    at = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 4 * 1.0 + 0.5).alias("x"), F.lit(1.0).alias("y"))
    most = []
    written = cut.Steps.write
    monkeypatch.setattr(cut.Steps, "write", lambda self, df: (lambda out: most.append(out.count()) or out)(written(self, df)))
    got = scatter.linear(src, at, "k").collect()
    assert len(got) == 2000 and all(r["value"] == pytest.approx(r["k"] % 4 + 2.5) for r in got)
    assert max(most) <= 64


def test_kriging_solves_once_a_place(spark, monkeypatch):
    """3,000 targets at six places: what is asked of the clouds is no more than those times the clouds."""
    src = spark.range(60).select((F.col("id") % 10 * 1.0).alias("x"), F.floor(F.col("id") / 10).cast("double").alias("y"), (F.col("id") % 7 * 1.0).alias("z"))
    at = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") % 6 + 0.5).alias("x"), F.lit(2.5).alias("y"))
    most = []
    written = cut.Steps.write

    def write(self, df):
        out = written(self, df)
        if "cloud" in out.columns:
            most.append(out.count())
        return out

    monkeypatch.setattr(cut.Steps, "write", write)
    got = kriging.krige_clouds(src, at, "k", "exponential", 0.1, 1.0, 5.0, most=20).collect()
    assert len(got) == 3000 and max(most) <= 60
    values = {}
    for r in got:
        values.setdefault(r["k"] % 6, set()).add((r["value"], r["error"]))
    assert all(len(v) == 1 for v in values.values()) and all(None not in next(iter(v)) for v in values.values())


def test_pieces_meet_once_without_a_shuffle_of_pairs(spark):
    grid = spark.range(30).select(F.floor(F.col("id") / 6).alias("j"), (F.col("id") % 6).alias("i"), (F.col("id") % 6 * 1.0).alias("x"), F.floor(F.col("id") / 6).cast("double").alias("y"))
    lines = spark.createDataFrame([("a", 0, 0.1, 0.2), ("a", 1, 4.9, 3.7), ("a", 2, 0.3, 3.1)], "line string, n int, x double, y double")
    found = coast.pieces(coast.measured(lines), grid, 0.7)
    assert "dropDuplicates" not in str(found) and "Deduplicate" not in found._jdf.queryExecution().analyzed().toString()
    rows = found.collect()
    assert sum(r["length"] for r in rows) == pytest.approx(math.hypot(4.8, 3.5) + math.hypot(4.6, 0.6))
    assert len({(r["s"], r["j"], r["i"]) for r in rows}) == len(rows) > 10


def test_one_position_needs_no_sort(spark):
    rows = [(k, float(x), None if (k * x) % 11 == 3 else float(k * x % 7)) for k in range(60) for x in range(-9, 10) if (k * 31 + x * 17) % 5 < 2]
    src = spark.createDataFrame([*rows, (70, None, 1.0)], "k int, x double, v double")
    for at in (0.0, -2.5, 8.5):
        targets = src.select("k").distinct().withColumn("x", F.lit(at))
        want = {r["k"]: r["value"] for r in interp.interp1d(src, targets, ["k"], "x", "v").collect()}
        got = {r["k"]: r["value"] for r in interp.at_position(src, ["k"], "x", "v", at).collect()}
        assert got == pytest.approx(want)
        assert len({v for v in want.values() if v is not None}) > 5


def test_layer_at_depth_is_one_shuffle_of_small_tasks(spark, tmp_path):
    """A profile's rows meet once, and stay for its levels and the depth: no sort, no window, and more tasks for more rows."""
    lines = spark.range(40).selectExpr("id div 4 as l_orderkey", "cast(id % 4 + 1 as int) as l_linenumber", "cast(id as double) as l_quantity", "0.0d as l_discount")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    plan = catalog.QUERIES["layer_at_depth"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Sort" not in plan
    assert "hashpartitioning(l_orderkey" in inputs.profiles(spark, str(tmp_path), together=4)._jdf.queryExecution().executedPlan().toString()
    assert ", 10), REPARTITION_BY_NUM" in inputs.profiles(spark, str(tmp_path), together=4)._jdf.queryExecution().executedPlan().toString()
