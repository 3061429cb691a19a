"""Unit conversions and vector components, as column expressions. Constants in SI units."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical constants.
EARTH_RADIUS = 6371006.0
GRAVITATION = 6.67428e-11
EARTH_MASS = 5.9736e24
GRAVITY = GRAVITATION * EARTH_MASS / EARTH_RADIUS**2
SIDEREAL_DAY = 86164.0


def kt2ms(c: Column) -> Column:
    return c * 0.514444


def ms2kt(c: Column) -> Column:
    return c / 0.514444


def mph2ms(c: Column) -> Column:
    return c * 0.44704


def ms2mph(c: Column) -> Column:
    return c * 2.237


def kel2degc(c: Column) -> Column:
    return c - 273.15


def degc2kel(c: Column) -> Column:
    return c + 273.15


def ms2bf(c: Column) -> Column:
    """Wind force on the Beaufort scale."""
    return F.round(F.cbrt(F.pow(c * 3.6, F.lit(2.0)) / 9)).cast("int")


def deg2m(degrees: Column, lat: Column | None = None) -> Column:
    metres = degrees * (math.pi * EARTH_RADIUS / 180)
    return metres if lat is None else metres * F.cos(F.radians(lat))


def m2deg(metres: Column, lat: Column | None = None) -> Column:
    degrees = metres / (math.pi * EARTH_RADIUS / 180)
    return degrees if lat is None else degrees / F.cos(F.radians(lat))


def dms2deg(d: Column, m: Column, s: Column) -> Column:
    """The sign is that of the degrees."""
    return F.when(d < 0, -1.0).otherwise(1.0) * (F.abs(d) + (m + s / 60) / 60)


def deg2dms(deg: Column) -> Column:
    """struct<d, m, s>, each with the sign of the angle."""
    sign, size = F.when(deg < 0, -1).otherwise(1), F.abs(deg)
    d = F.floor(size)
    m = F.floor((size - d) * 60)
    return F.struct((sign * d).cast("int").alias("d"), (sign * m).cast("int").alias("m"), (sign * ((size - d) * 60 - m) * 60).alias("s"))


def modulus(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def direction(u: Column, v: Column) -> Column:
    """Mathematical direction of a vector, 0 to 360 degrees."""
    return F.pmod(F.degrees(F.atan2(v, u)), F.lit(360.0))


def component_x(mod: Column, angle: Column) -> Column:
    return mod * F.cos(F.radians(angle % 360))


def component_y(mod: Column, angle: Column) -> Column:
    return mod * F.sin(F.radians(angle % 360))


COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


def compass(angle: Column, from_north: bool = True) -> Column:
    """Compass point of an angle: clockwise from north as it is, or mathematical."""
    clockwise = angle if from_north else 90 - angle
    names = F.array(*[F.lit(n) for n in COMPASS])
    return F.element_at(names, (F.pmod(F.floor((clockwise + 11.25) / 22.5), F.lit(16)) + 1).cast("int"))


#: unit: (unit of the metric system, scale, offset); value in metric = value * scale + offset
METRIC = {
    "m": ("m", 1.0, 0.0), "km": ("m", 1000.0, 0.0), "cm": ("m", 0.01, 0.0), "mm": ("m", 0.001, 0.0), "nmi": ("m", 1852.0, 0.0), "ft": ("m", 0.3048, 0.0),
    "m/s": ("m/s", 1.0, 0.0), "km/h": ("m/s", 1 / 3.6, 0.0), "kt": ("m/s", 0.514444, 0.0), "mph": ("m/s", 0.44704, 0.0), "cm/s": ("m/s", 0.01, 0.0),
    "K": ("K", 1.0, 0.0), "degC": ("K", 1.0, 273.15), "degF": ("K", 5 / 9, 273.15 - 32 * 5 / 9),
    "Pa": ("Pa", 1.0, 0.0), "hPa": ("Pa", 100.0, 0.0), "mbar": ("Pa", 100.0, 0.0), "dbar": ("Pa", 1e4, 0.0), "bar": ("Pa", 1e5, 0.0),
}


#: base units of compound ones: (dimension, scale to the metric system)
BASE = {
    "m": ("m", 1.0), "km": ("m", 1e3), "cm": ("m", 1e-2), "mm": ("m", 1e-3), "ft": ("m", 0.3048), "nmi": ("m", 1852.0), "s": ("s", 1.0), "min": ("s", 60.0), "h": ("s", 3600.0), "day": ("s", 86400.0),
    "kg": ("kg", 1.0), "g": ("kg", 1e-3), "t": ("kg", 1e3), "K": ("K", 1.0), "J": ("J", 1.0), "W": ("W", 1.0), "N": ("N", 1.0), "Pa": ("Pa", 1.0), "hPa": ("Pa", 100.0), "dbar": ("Pa", 1e4),
}


def parse_unit(unit: str) -> tuple[dict[str, int], float, float]:
    """Dimensions, scale and offset of a unit: one of METRIC, or a product as 'kg m-3', 'cm s-1', 'W/m2', 'm^2 s^-1'."""
    if unit in METRIC:
        name, scale, offset = METRIC[unit]
        dims, base, _ = parse_unit(name) if name != unit else ({name: 1}, 1.0, 0.0) if "/" not in name else _product(name)
        return dims, scale * base, offset
    return _product(unit)


def _product(unit: str) -> tuple[dict[str, int], float, float]:
    dims: dict[str, int] = {}
    scale, over = 1.0, 1
    for token in re.findall(r"/|[A-Za-z]+\^?-?[0-9]*", unit):
        if token == "/":
            over = -1
            continue
        name, power = re.fullmatch(r"([A-Za-z]+)\^?(-?[0-9]*)", token).groups()
        if name not in BASE:
            raise ValueError(f"no unit: {unit}")
        n = int(power or 1) * over
        dimension, factor = BASE[name]
        dims[dimension] = dims.get(dimension, 0) + n
        scale *= factor**n
    return {d: n for d, n in dims.items() if n}, scale, 0.0


def convert(c: Column, old: str, new: str) -> Column:
    """Between two units of one dimension, simple or compound; raises ValueError otherwise."""
    (dims, scale, offset), (to_dims, to_scale, to_offset) = parse_unit(old), parse_unit(new)
    if dims != to_dims:
        raise ValueError(f"{old} and {new} are units of different kinds")
    return (c * scale + offset - to_offset) / to_scale


def to_metric(c: Column, unit: str) -> Column:
    return convert(c, unit, METRIC[unit][0]) if unit in METRIC else F.lit(None).cast("double")
