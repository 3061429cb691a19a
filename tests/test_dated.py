"""Dated file sets, coasts and saved grids."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from halocline.operators import coast, colocate
from halocline.sources import dated, files


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    """Files of a day that hold two days each, and others that are no dates."""
    root = str(tmp_path_factory.mktemp("runs"))
    for day in (1, 2, 4):
        rows = [(datetime(2024, 3, day + k, h), 100.0 * day + k) for k in (0, 1) for h in (0, 12)]
        spark.createDataFrame(rows, "t timestamp_ntz, v double").coalesce(1).write.parquet(f"{root}/run_2024030{day}")
    spark.range(1).write.parquet(f"{root}/run_20249999")
    return root


def test_files_stand_until_the_next(spark, runs):
    found = dated.list_dated(spark, runs, "run_%Y%m%d")
    assert [(f.start.day, f.until and f.until.day) for f in found] == [(1, 2), (2, 4), (4, None)]
    got = dated.scan(spark, runs, "run_%Y%m%d", "t")
    assert sorted((r["t"].day, r["t"].hour, r["v"]) for r in got.collect()) == [(1, 0, 100.0), (1, 12, 100.0), (2, 0, 200.0), (2, 12, 200.0), (3, 0, 201.0), (3, 12, 201.0), (4, 0, 400.0), (4, 12, 400.0), (5, 0, 401.0), (5, 12, 401.0)]


def test_other_days_are_not_opened(spark, runs):
    got = dated.scan(spark, runs, "run_%Y%m%d", "t", datetime(2024, 3, 2, 6), datetime(2024, 3, 3, 6))
    assert {p.split("/")[-2] for p in got.inputFiles()} == {"run_20240302"}
    assert sorted((r["v"], r["file_date"].day) for r in got.collect()) == [(200.0, 2), (201.0, 2)]
    assert "PushedFilters: [IsNotNull(t)" in got._jdf.queryExecution().toString() or "PushedFilters" in got._jdf.queryExecution().toString()
    every = dated.scan(spark, runs, "run_%Y%m%d", "t", datetime(2024, 3, 2, 6), datetime(2024, 3, 2, 20), cut=False)
    assert {p.split("/")[-2] for p in every.inputFiles()} == {"run_20240301", "run_20240302"}
    assert sorted(r["v"] for r in every.collect()) == [101.0, 200.0]


def test_no_file_is_needed(spark, runs):
    with pytest.raises(FileNotFoundError):
        dated.scan(spark, runs, "run_%Y%m%d", "t", hi=datetime(2023, 1, 1))
    assert dated.scan(spark, runs, "run_%Y%m%d", "t", hi=datetime(2023, 1, 1), schema="t timestamp_ntz, v double").count() == 0
    with pytest.raises(ValueError, match="no date"):
        dated.scan(spark, runs, "run", "t")


def test_saved_grids(spark, tmp_path):
    grid = spark.range(12).select((F.col("id") % 3).alias("j"), F.floor(F.col("id") / 3).alias("i"), F.when(F.col("id") != 5, F.col("id").cast("double")).alias("z"))
    files.save_grid(grid, f"{tmp_path}/all")
    files.save_grid(grid, f"{tmp_path}/valid", masked=False)
    assert sorted(map(tuple, files.read(spark, f"{tmp_path}/all").collect())) == sorted(map(tuple, grid.collect()))
    assert files.read(spark, f"{tmp_path}/valid").count() == 11


def test_values_along_a_line(spark):
    lines = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 2, 4.0, 0.0), ("a", 3, 4.0, 4.0), ("b", 1, 100.0, 0.0), ("b", 2, 110.0, 0.0), ("c", 1, 50.0, 50.0)], "line string, n int, x double, y double")
    at = spark.createDataFrame([(1, 1.0, 0.5, 10.0), (2, 4.5, 3.0, 20.0), (3, 4.4, 3.0, 40.0), (4, 60.0, 60.0, 9.0), (5, None, 0.0, 1.0)], "k int, x double, y double, z double")
    got = {r["k"]: (r["line"], r["s"], r["distance"]) for r in coast.along(at, "k", coast.measured(lines), 1.5).collect()}
    assert got == {1: ("a", 1.0, 0.5), 2: ("a", 7.0, pytest.approx(0.5)), 3: ("a", 7.0, pytest.approx(0.4))}
    found = {(r["line"], r["n"]): r["z"] for r in coast.values_along(at, "k", "z", lines, 1.5).collect()}
    assert found == {("a", 1): 10.0, ("a", 2): pytest.approx(20.0), ("a", 3): 30.0, ("b", 1): None, ("b", 2): None, ("c", 1): None}
    inner = {(r["line"], r["n"]): r["z"] for r in coast.values_along(at, "k", "z", lines, 1.5, extrapolate=False, smooth=True).collect()}
    assert inner["a", 1] is None and inner["a", 2] == pytest.approx(20.0) and inner["a", 3] is None
    assert {r["z"] for r in coast.coastal_depths(at, "k", "z", lines, 1.5).filter("line = 'a' and n < 3").collect()} == {20.0, 40.0}


def test_colocation_knows_its_limits(spark):
    """Between two times and depths; beyond them, and far from all columns, nothing; a missing cell is not stepped over."""
    cells = [(c, lon, 0.0, t, z, 10.0 * t + z / 10 + c, 35.0) for c, lon in ((1, 0.0), (2, 10.0)) for t in (0.0, 6.0) for z in (-10.0, -20.0, -40.0)]
    cells = [(*r[:5], None if r[0] == 2 and r[4] == -20.0 else r[5], r[6]) for r in cells]
    model = spark.createDataFrame(cells, "c int, lon double, lat double, time double, depth double, temp double, sal double")
    asked = spark.createDataFrame([(1, 1.0, 0.0, 3.0, -15.0), (2, 1.0, 0.0, 7.0, -15.0), (3, 1.0, 0.0, 3.0, -5.0), (4, 9.0, 0.0, 0.0, -30.0), (5, 9.0, 0.0, 0.0, -40.0), (6, 90.0, 0.0, 0.0, -10.0)], "p int, lon double, lat double, time double, depth double")
    got = {r["p"]: r for r in colocate.with_pressure_and_density(colocate.colocate_strata(model, "c", asked, "p", 4.0, farthest=1e6)).collect()}
    assert {k: r["temp"] for k, r in got.items()} == {1: pytest.approx(30 - 1.5 + 1), 2: None, 3: None, 4: None, 5: pytest.approx(-2.0), 6: None}
    assert got[1]["c"] == 1 and got[4]["c"] == 2 and got[6]["c"] is None
    assert got[1]["dens"] > 1000 and got[2]["dens"] is None


def test_sections_through_a_bent_grid(spark):
    """Pieces are as long as the way inside, run on without gaps, and a plane is met exactly."""
    grid = spark.range(80).select(F.floor(F.col("id") / 10).cast("int").alias("j"), (F.col("id") % 10).cast("int").alias("i"))
    grid = grid.withColumns({"x": F.col("i") + 0.3 * F.col("j") + 0.02 * F.col("i") * F.col("i"), "y": F.col("j") - 0.2 * F.col("i") + 0.01 * F.col("i") * F.col("j")})
    ways = spark.createDataFrame([("a", 1, 1.5, 0.5), ("a", 2, 7.0, 4.0), ("a", 3, 4.0, 4.5), ("b", 1, 3.0, 1.0), ("b", 2, 100.0, 1.0), ("c", 1, 500.0, 500.0), ("c", 2, 501.0, 500.0)], "line string, n int, x double, y double")
    lines = coast.measured(ways)
    found = coast.pieces(lines, grid, 1.5).cache()
    assert {r["line"] for r in found.select("line").distinct().collect()} == {"a", "b"}
    a = sorted((r["s"], r["length"]) for r in found.filter("line = 'a'").collect())
    whole = (5.5**2 + 3.5**2) ** 0.5 + (9.25) ** 0.5
    assert sum(n for _, n in a) == pytest.approx(whole)
    assert all(s + n / 2 == pytest.approx(t - m / 2, abs=1e-8) for (s, n), (t, m) in zip(a, a[1:], strict=False))
    plane = grid.withColumn("v", 2 * F.col("x") - F.col("y")).withColumn("w", F.when(F.col("i") != 4, F.lit(1.0)))
    got = coast.along_section(found, plane, ["v", "w"]).collect()
    assert len(got) == found.count()
    for r in got:
        if r["line"] == "a" and r["s"] < (5.5**2 + 3.5**2) ** 0.5:
            t = r["s"] / (5.5**2 + 3.5**2) ** 0.5
            assert r["v"] == pytest.approx(2 * (1.5 + 5.5 * t) - (0.5 + 3.5 * t))
    assert {r["w"] and round(r["w"], 9) for r in got} == {None, 1.0}
