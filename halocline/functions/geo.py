"""Distances, projections and lines on the sphere and in the plane, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from halocline.functions.units import EARTH_RADIUS


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_RADIUS) -> Column:
    """Great-circle distance in the unit of ``radius``; degrees in."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * radius * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def planar(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * EARTH_RADIUS, F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * EARTH_RADIUS


def inverse_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / EARTH_RADIUS), F.degrees(2 * F.atan(F.exp(y / EARTH_RADIUS)) - math.pi / 2)


def basic_projection(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres east, at the point's latitude, and north."""
    scale = math.pi * EARTH_RADIUS / 180
    return lon * scale * F.cos(F.radians(lat)), lat * scale


def rotate(x: Column, y: Column, angle: float, x0: float = 0.0, y0: float = 0.0) -> tuple[Column, Column]:
    """About (x0, y0), counter-clockwise, degrees."""
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return x0 + (x - x0) * c - (y - y0) * s, y0 + (x - x0) * s + (y - y0) * c


def closest_on_line(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """The point of the line through two points that is closest to (x, y)."""
    dx, dy = x2 - x1, y2 - y1
    t = ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)
    return x1 + t * dx, y1 + t * dy


def distance_to_line(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.abs((x2 - x1) * (y1 - y) - (x1 - x) * (y2 - y1)) / planar(x1, y1, x2, y2)


def in_quadrangle(x: Column, y: Column, corners: list[tuple[Column, Column]]) -> Column:
    """struct<p, q>: position of (x, y) in a quadrangle of corners in turn, from 0 to 1 each inside; the inverse of the
    bilinear map p along the first side, q along the last. Null where the map cannot be inverted."""
    (x1, y1), (x2, y2), (x3, y3), (x4, y4) = corners
    ax, ay, bx, by = x2 - x1, y2 - y1, x4 - x1, y4 - y1
    cx, cy = x1 - x2 + x3 - x4, y1 - y2 + y3 - y4
    dx, dy = x - x1, y - y1
    # q solves k2 q^2 + k1 q + k0 = 0
    k2, k1, k0 = bx * cy - by * cx, dy * cx - dx * cy + bx * ay - by * ax, dy * ax - dx * ay
    root = F.sqrt(k1 * k1 - 4 * k2 * k0)
    flat = F.abs(k2) < 1e-12
    q1, q2 = (-k1 + root) / (2 * k2), (-k1 - root) / (2 * k2)
    q = F.when(flat, -k0 / k1).when((q1 >= -1e-9) & (q1 <= 1 + 1e-9), q1).otherwise(q2)
    px, py = ax + cx * q, ay + cy * q
    p = F.when(F.abs(px) > F.abs(py), (dx - bx * q) / px).otherwise((dy - by * q) / py)
    return F.struct(p.alias("p"), q.alias("q"))
