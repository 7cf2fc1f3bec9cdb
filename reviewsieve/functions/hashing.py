"""Portable hash order: the same draw in every engine and under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(part) -> Column:
    if isinstance(part, Column):
        return part
    return F.col(part) if isinstance(part, str) else F.lit(part)


def draw(*parts) -> Column:
    """md5 over the parts joined by ``|``. Strings name columns, numbers are literals."""
    return F.md5(F.concat_ws("|", *[_col(p).cast("string") for p in parts]))


def unit_draw(*parts) -> Column:
    """A draw scaled to [0, 1): its first 8 hex digits over 2^32."""
    return F.conv(F.substring(draw(*parts), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
