"""Qualification level lookup by ISCO major group (a map literal, no join)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skillweave.config import FALLBACK_LEVEL, ISCO_MAJOR_GROUP_LEVEL


def _level_map(level_map: dict) -> Column:
    entries = []
    for k, v in sorted(level_map.items()):
        entries += [F.lit(int(k)), F.lit(v)]
    return F.create_map(*entries)


def required_level(isco_col, level_map: dict = ISCO_MAJOR_GROUP_LEVEL,
                   fallback: str = FALLBACK_LEVEL) -> Column:
    """Level for the group; null or unknown group gives the fallback."""
    c = F.col(isco_col) if isinstance(isco_col, str) else isco_col
    return F.coalesce(F.try_element_at(_level_map(level_map), c.cast("int")), F.lit(fallback))


def level_is_fallback(isco_col, level_map: dict = ISCO_MAJOR_GROUP_LEVEL) -> Column:
    c = F.col(isco_col) if isinstance(isco_col, str) else isco_col
    return F.try_element_at(_level_map(level_map), c.cast("int")).isNull()
