"""Text of positions, sizes and names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _degrees(c: Column, negative: str, positive: str) -> Column:
    whole = F.floor(F.abs(c))
    minutes = F.floor((F.abs(c) - whole) * 60)
    return F.concat(whole.cast("string"), F.lit("°"), F.lpad(minutes.cast("string"), 2, "0"), F.lit("'"), F.when(c < 0, negative).otherwise(positive))


def longitude(c: Column) -> Column:
    """As 12°30'W."""
    return _degrees(c, "W", "E")


def latitude(c: Column) -> Column:
    return _degrees(c, "S", "N")


def depth(c: Column) -> Column:
    return F.concat(F.format_string("%g", F.abs(c)), F.lit("m"))


def parse_degrees(s: Column) -> Column:
    """Degrees of texts as 48°23'N; null if they are none."""
    parts = r"^\s*(\d+)\s*°\s*(\d+(?:\.\d+)?)?\s*'?\s*([NSEW])\s*$"
    d, m, side = (F.regexp_extract(s, parts, k) for k in (1, 2, 3))
    size = d.try_cast("double") + F.coalesce(m.try_cast("double"), F.lit(0.0)) / 60
    return F.when(s.rlike(parts), F.when(side.isin("S", "W"), -size).otherwise(size))


def size(c: Column) -> Column:
    """Bytes as o, Kio or Mio."""
    return F.when(c < 1024, F.format_string("%.1f o", c)).when(c < 1048576, F.format_string("%.1f Kio", c / 1024)).otherwise(F.format_string("%.1f Mio", c / 1048576))


def strip_tags(s: Column, instead: str = "") -> Column:
    return F.regexp_replace(s, "<[^>]+>", instead)


def matches(s: Column, pattern: str, ignore_case: bool = True) -> Column:
    return (F.lower(s) if ignore_case else s).rlike(pattern)


def location_of(name: str) -> str | None:
    """Place on a grid that a variable's name ends with: temp_u is u."""
    return name[-1] if len(name) > 2 and name[-2] == "_" and name[-1] in "tuvwf" else None


def change_location(name: str, place: str | None) -> str:
    base = name[:-2] if location_of(name) else name
    return base if place is None else f"{base}_{place}"


PLACE = "(?:_at_([tuvwf])_location|_([tuvwf]))$"


def place(name: Column) -> Column:
    """Place on a grid that a variable's name ends with, temp_u and temp_at_u_location; null if it has none."""
    both = F.concat(F.regexp_extract(name, PLACE, 1), F.regexp_extract(name, PLACE, 2))
    return F.when(both != "", both)


def base_name(name: Column) -> Column:
    """Without the place."""
    return F.regexp_replace(name, PLACE, "")


def at_place(name: Column, place_: str) -> Column:
    return F.concat(base_name(name), F.lit(f"_{place_}"))


def phase(c: Column, kind: str | None = None, decimals: int | None = None, seconds: bool = True) -> Column:
    """Degrees as 12°30'15''; with ``decimals`` as 12.5°. kind: lon or lat adds E, W, N or S, else a sign stays."""
    size = F.abs(c)
    if decimals is not None:
        text = F.format_string(f"%.{decimals}f°", size)
    else:
        total = F.round(size * 3600).cast("long") if seconds else F.round(size * 60).cast("long") * 60
        d, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
        text = F.concat(d.cast("string"), F.lit("°"), F.lpad(m.cast("string"), 2, "0"), F.lit("'"))
        if seconds:
            text = F.concat(text, F.lpad(s.cast("string"), 2, "0"), F.lit("''"))
    if kind is None:
        return F.concat(F.when(c < 0, "-").otherwise(""), text)
    negative, positive = {"lon": ("W", "E"), "lat": ("S", "N")}[kind]
    return F.concat(text, F.when(c < 0, negative).otherwise(positive))
