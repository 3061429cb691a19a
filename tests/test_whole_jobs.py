"""Queries do the whole of their job: cases that an earlier cut left out."""

from halocline.plans import catalog


def test_layer_at_depth_without_levels_2_or_3(spark, tmp_path):
    rows = [
        (1, 1, 10.0), (1, 4, 40.0),  # neither level 2 nor 3
        (2, 2, 10.0), (2, 3, 20.0), (2, 7, 90.0),  # both: the nearest count
        (3, 1, 10.0), (3, 3, 30.0),  # no level 2
        (4, 1, 10.0), (4, 2, 30.0),  # nothing below
        (5, 5, 10.0),  # nothing above
    ]
    lineitem = spark.createDataFrame([(*r, 0.0) for r in rows], "l_orderkey long, l_linenumber int, l_quantity double, l_discount double")
    lineitem.write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r["profile"]: r["temp"] for r in catalog.QUERIES["layer_at_depth"](spark, str(tmp_path)).collect()}
    assert got == {1: 12.5, 2: 7.5, 3: 12.5}
