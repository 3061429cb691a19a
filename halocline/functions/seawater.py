"""Equation of state of sea water (EOS-80) and what follows from it, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from halocline.functions.units import GRAVITY, SIDEREAL_DAY

# EOS-80 (UNESCO 1983) coefficients, by powers of temperature from 0 up.
RHO_W = [999.842594, 6.793952e-2, -9.095290e-3, 1.001685e-4, -1.120083e-6, 6.536332e-9]
RHO_S = [8.24493e-1, -4.0899e-3, 7.6438e-5, -8.2467e-7, 5.3875e-9]
RHO_S32 = [-5.72466e-3, 1.0227e-4, -1.6546e-6]
RHO_S2 = 4.8314e-4
K_W = [19652.21, 148.4206, -2.327105, 1.360477e-2, -5.155288e-5]
K_S = [54.6746, -0.603459, 1.09987e-2, -6.1670e-5]
K_S32 = [7.944e-2, 1.6483e-2, -5.3009e-4]
A_W = [3.239908, 1.43713e-3, 1.16092e-4, -5.77905e-7]
A_S = [2.2838e-3, -1.0981e-5, -1.6078e-6]
A_S32 = 1.91075e-4
B_W = [8.50935e-5, -6.12293e-6, 5.2787e-8]
B_S = [-9.9348e-7, 2.0816e-8, 9.1697e-10]


def _polynomial(t: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * t + c
    return out


def pressure(depth: Column, lat: Column) -> Column:
    """dbar, from depth in metres, positive down (Saunders 1981)."""
    c = 5.92e-3 + 5.25e-3 * F.pow(F.sin(F.radians(lat)), F.lit(2.0))
    return ((1 - c) - F.sqrt((1 - c) * (1 - c) - 8.84e-6 * depth)) / 4.42e-6


def surface_density(temp: Column, sal: Column) -> Column:
    s32 = sal * F.sqrt(sal)
    return _polynomial(temp, RHO_W) + _polynomial(temp, RHO_S) * sal + _polynomial(temp, RHO_S32) * s32 + RHO_S2 * sal * sal


def density(temp: Column, sal: Column, depth: Column | None = None, lat: Column | None = None) -> Column:
    """In situ density in kg m-3; without depth that at the surface, which is the potential density."""
    rho0 = surface_density(temp, sal)
    if depth is None:
        return rho0
    bar, s32 = pressure(depth, F.lit(0.0) if lat is None else lat) / 10, sal * F.sqrt(sal)
    k0 = _polynomial(temp, K_W) + _polynomial(temp, K_S) * sal + _polynomial(temp, K_S32) * s32
    a = _polynomial(temp, A_W) + _polynomial(temp, A_S) * sal + A_S32 * s32
    b = _polynomial(temp, B_W) + _polynomial(temp, B_S) * sal
    return rho0 / (1 - bar / (k0 + a * bar + b * bar * bar))


def coriolis(lat: Column) -> Column:
    return 2 * F.sin(F.radians(lat)) * (2 * math.pi / SIDEREAL_DAY)


def wind_stress(u: Column, v: Column, air: float = 1.25, drag: float = 0.016) -> tuple[Column, Column]:
    speed = F.sqrt(u * u + v * v)
    return drag * air * speed * u, drag * air * speed * v


def wind_from_stress(tx: Column, ty: Column, air: float = 1.25, drag: float = 0.016) -> tuple[Column, Column]:
    """The inverse of wind_stress; no stress is no wind."""
    size = F.sqrt(tx * tx + ty * ty)
    scale = F.when(size == 0, 0.0).otherwise(1 / F.sqrt(size * (drag * air)))
    return scale * tx, scale * ty


def sigma_depth(sigma: Column, bottom: Column, eta: Column, kind: str = "standard") -> Column:
    """z of a sigma level, positive up: ``standard`` or ``ocean``."""
    return sigma * (eta + bottom) + (eta if kind == "standard" else -bottom)


def generalized_depth(s: Column, bottom: Column, eta: Column, critical: float, a: float, b: float) -> Column:
    """z of an s level with surface (a) and bottom (b) stretching, below a critical depth."""
    stretch = (1 - b) * F.sinh(a * s) / math.sinh(a) + b * (F.tanh(a * (s + 0.5)) / (2 * math.tanh(0.5 * a)) - 0.5)
    return eta * (1 + s) + critical * s + (bottom - critical) * stretch


def sigma_altitude(sigma: Column, height: Column, orography: Column) -> Column:
    return sigma / height * (height - orography) + orography


__all__ = ["GRAVITY", "coriolis", "density", "generalized_depth", "pressure", "sigma_altitude", "sigma_depth", "surface_density", "wind_from_stress", "wind_stress"]
