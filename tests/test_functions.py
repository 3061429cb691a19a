"""Closed forms."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from halocline.functions import geo, labels, seawater, times, units
from halocline.operators import points


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(x):
    return F.lit(float(x))


@pytest.mark.parametrize(("t", "s", "expected"), [(5, 0, 999.96675), (5, 35, 1027.67547), (25, 35, 1023.34306)])
def test_surface_density(spark, t, s, expected):
    assert value(spark, seawater.surface_density(lit(t), lit(s))) == pytest.approx(expected, abs=1e-4)


def test_pressure(spark):
    assert value(spark, seawater.pressure(lit(7321.45), lit(30))) == pytest.approx(7500.007, abs=1e-2)


def test_wind_stress_round_trip(spark):
    u, v = seawater.wind_from_stress(*seawater.wind_stress(lit(3), lit(-4)))
    assert (value(spark, u), value(spark, v)) == (pytest.approx(3), pytest.approx(-4))
    assert value(spark, seawater.wind_from_stress(lit(0), lit(0))[0]) == 0


def test_sigma_at_surface_and_bottom(spark):
    assert value(spark, seawater.sigma_depth(lit(0), lit(100), lit(0.5))) == 0.5
    assert value(spark, seawater.sigma_depth(lit(-1), lit(100), lit(0.5))) == -100
    assert value(spark, seawater.generalized_depth(lit(-1), lit(100), lit(0.5), 10.0, 3.0, 0.4)) == pytest.approx(-100)


def test_haversine(spark):
    assert value(spark, geo.haversine(lit(0), lit(0), lit(1), lit(0))) == pytest.approx(units.EARTH_RADIUS * math.pi / 180)
    assert value(spark, geo.haversine(lit(179.5), lit(0), lit(-179.5), lit(0))) == pytest.approx(units.EARTH_RADIUS * math.pi / 180)


def test_mercator_round_trip(spark):
    lon, lat = geo.inverse_mercator(*geo.mercator(lit(-12.5), lit(48.2)))
    assert (value(spark, lon), value(spark, lat)) == (pytest.approx(-12.5), pytest.approx(48.2))


@pytest.mark.parametrize(("p", "q"), [(0.25, 0.75), (0.0, 0.0), (0.9, 0.1)])
def test_quadrangle_inverts_the_bilinear_map(spark, p, q):
    c = [(0.0, 0.0), (4.0, 1.0), (5.0, 5.0), (-1.0, 3.0)]
    w = [(1 - p) * (1 - q), p * (1 - q), p * q, (1 - p) * q]
    x, y = sum(a * k for a, (k, _) in zip(w, c, strict=True)), sum(a * k for a, (_, k) in zip(w, c, strict=True))
    found = value(spark, geo.in_quadrangle(lit(x), lit(y), [(lit(a), lit(b)) for a, b in c]))
    assert (found["p"], found["q"]) == (pytest.approx(p, abs=1e-9), pytest.approx(q, abs=1e-9))


def test_units(spark):
    assert value(spark, units.convert(lit(10), "km/h", "m/s")) == pytest.approx(10 / 3.6)
    assert value(spark, units.convert(lit(32), "degF", "degC")) == pytest.approx(0)
    assert value(spark, units.dms2deg(lit(-4), lit(30), lit(0))) == -4.5
    assert value(spark, units.compass(lit(359))) == "N"
    with pytest.raises(ValueError, match="different kinds"):
        units.convert(lit(1), "m", "K")


def test_rounding_of_dates(spark):
    at = F.lit("2024-03-31 22:40:00").cast("timestamp_ntz")
    assert value(spark, times.round_date(at, "hour", 6, "floor")) == datetime(2024, 3, 31, 18)
    assert value(spark, times.round_date(at, "hour", 6, "ceil")) == datetime(2024, 4, 1)
    assert value(spark, times.round_date(at, "day")) == datetime(2024, 4, 1)
    assert value(spark, times.add_time(F.lit("2024-01-31").cast("timestamp_ntz"), 1, "month")) == datetime(2024, 2, 29)
    assert value(spark, times.change_units(lit(24), "hour", "1950-01-02", "day", "1950-01-01")) == 2


def test_labels(spark):
    assert value(spark, labels.parse_degrees(F.lit("48°30'N"))) == 48.5
    assert value(spark, labels.parse_degrees(F.lit("nowhere"))) is None
    assert labels.change_location("temp_u", "v") == "temp_v"


def test_polygon(spark):
    shape = [(0, 0), (5, 0), (4, 2), (1, 2)]
    assert value(spark, points.area(points.polygon(shape))) == pytest.approx(8)
    assert value(spark, points.inside(lit(2), lit(1), points.polygon(shape))) is True
    assert value(spark, points.inside(lit(0.2), lit(1.5), points.polygon(shape))) is False
    assert points.clip_box(shape, (0, 0, 10, 1)) == [(0, 0), (5, 0), (4.5, 1.0), (0.5, 1.0)]
