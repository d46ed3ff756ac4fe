"""Small helpers for higher-order array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``; a lambda would re-evaluate it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)
