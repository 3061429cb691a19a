"""Maps and arrays of options, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_prefix(m: Column, prefix: str, short: bool = True) -> Column:
    """Entries whose key starts with ``prefix`` and an underscore; ``short``: without these."""
    kept = F.map_filter(m, lambda k, _: k.startswith(prefix + "_"))
    return F.transform_keys(kept, lambda k, _: F.substring(k, F.lit(len(prefix) + 2), F.length(k))) if short else kept


def without_prefix(m: Column, prefix: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.startswith(prefix + "_"))


def first_of(m: Column, *aliases: str) -> Column:
    """Value of the first key that is there."""
    return F.coalesce(*[F.try_element_at(m, F.lit(a)) for a in aliases])


def choose(index: Column, *choices: Column) -> Column:
    """The choice with a number, from 0; null beyond."""
    return F.get(F.array(*choices), index)


def unique(a: Column) -> Column:
    """Without repeats, in order of first place."""
    return F.array_distinct(a)
