"""Reproducible randomness (R1): draws are a pure function of (seed, draw name, unit id),
so results do not depend on partitioning, task retries or executor loss."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def draw_key(seed, draw, unit) -> Column:
    """md5 hex of 'seed:draw:unit'."""
    seed_c = seed if isinstance(seed, Column) else F.lit(str(seed))
    draw_c = draw if isinstance(draw, Column) else F.lit(str(draw))
    return F.md5(F.concat_ws(":", seed_c.cast("string"), draw_c.cast("string"), _c(unit).cast("string")))


def seeded_uniform(seed, draw, unit) -> Column:
    """u in [0, 1): the first 8 hex digits of the draw key as an integer / 2^32."""
    return F.conv(F.substring(draw_key(seed, draw, unit), 1, 8), 16, 10).cast("bigint") / F.lit(TWO_32)
