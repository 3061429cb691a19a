"""Datasets asked for by name."""

import pytest
from pyspark.sql import functions as F

from halocline.functions.seawater import density
from halocline.sources.dataset import append_missing, open_dataset


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("ds") / "t")
    rows = [(1, 45.0 + y, -5.0 + x, -10.0 * z, 15.0 - z, 35.0) for y in range(2) for x in range(3) for z in range(4)]
    spark.createDataFrame(rows, "time int, latitude double, nav_lon double, depth double, votemper double, PSAL double").write.parquet(out)
    return out


def test_select_and_read(spark, path):
    got = open_dataset(spark, path).get("temp", lon=(-5.0, -3.0, "co"), level=(-20.0, None))
    assert got.columns == ["time", "depth", "lat", "lon", "temp"]
    assert got.count() == 2 * 2 * 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PSAL" not in plan
    assert "LessThan(nav_lon,-3.0)" in plan


def test_derived(spark, path):
    ds = open_dataset(spark, path)
    r = ds.get("dens", lat=(46.0, 46.0), lon=(-5.0, -5.0), level=(-30.0, -30.0)).first()
    expected = spark.range(1).select(density(F.lit(12.0), F.lit(35.0), F.lit(30.0), F.lit(46.0)).alias("d")).first()["d"]
    assert r["dens"] == pytest.approx(expected)
    assert all(x["mld"] == pytest.approx(1.4, abs=0.3) for x in ds.get("mld").collect())
    assert ds.get("ssd").count() == 6
    with pytest.raises(KeyError):
        ds.get("speed")
    with pytest.raises(KeyError):
        ds.get("nothing")


def test_append_missing(spark, tmp_path):
    out = str(tmp_path / "cache")
    for n in (3, 5):
        append_missing(spark.range(n).withColumn("v", F.lit(n)), out, ["id"])
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(out).collect()) == [(0, 3), (1, 3), (2, 3), (3, 5), (4, 5)]
