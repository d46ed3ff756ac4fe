"""Reproducible random draws from row keys.

A draw depends only on its key and seed: it survives task retries, repartitioning and a change
of engine, which a per-partition generator does not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed, *keys: Column | str) -> Column:
    """Hex digest that orders rows at random."""
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    salt = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", *parts, salt))


def uniform(seed, *keys: Column | str) -> Column:
    """Number in [0, 1)."""
    return F.conv(F.substring(draw_key(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def gaussian(seed, *keys: Column | str) -> Column:
    """Standard normal number by the Box-Muller rule on two draws."""
    radius = F.sqrt(-2.0 * F.log(1.0 - uniform(f"{seed}a", *keys)))
    return radius * F.cos(2.0 * math.pi * uniform(f"{seed}b", *keys))
