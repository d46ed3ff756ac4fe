"""Quality signals of a (parcel, time step) cell."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: pixel count at which the pixel signal saturates.
PX_FULL = 256.0


def _clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def cloud_norm(cloud: Column, observed: Column) -> Column:
    return F.when(observed, _clip(cloud / 100.0, 0.0, 1.0)).otherwise(F.lit(1.0))


def px_norm(px: Column, observed: Column) -> Column:
    level = F.log1p(F.greatest(px, F.lit(0.0))) / math.log1p(PX_FULL)
    return F.when(observed, _clip(level, 0.0, 1.0)).otherwise(F.lit(0.0))


def reliability(observed: Column, cloud: Column, px: Column) -> Column:
    """``cloud`` and ``px`` are the normalised signals."""
    return F.when(observed, (1.0 - cloud) * F.sqrt(_clip(px, 0.0, 1.0))).otherwise(F.lit(0.0))


def quality_struct(observed: Column, cloud: Column, px: Column) -> Column:
    c, p = cloud_norm(cloud, observed), px_norm(px, observed)
    return F.struct(
        reliability(observed, c, p).alias("reliability"),
        c.alias("cloud_norm"),
        p.alias("px_norm"),
    )


def quality_inputs(observed: Column, quality: Column | None = None) -> Column:
    """Three-element quality array: the given one cut or padded to 3 and clamped, else a fallback."""
    seen = observed.cast("double")
    if quality is None:
        return F.array(seen, 1.0 - seen, seen)
    padded = F.slice(F.concat(quality, F.array_repeat(F.lit(0.0), 3)), 1, 3)
    unseen = F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))
    return F.when(observed, F.transform(padded, lambda q: _clip(q, 0.0, 1.0))).otherwise(unseen)


def doy_fourier(doy: Column) -> Column:
    angle = _clip(doy.cast("double"), 1.0, 366.0) * (2.0 * math.pi / 366.0)
    return F.struct(F.sin(angle).alias("doy_sin"), F.cos(angle).alias("doy_cos"))


def standardise(x: Column, mean: Column, std: Column, observed: Column | None = None) -> Column:
    scaled = (x - mean) / std
    return scaled if observed is None else F.when(observed, scaled).otherwise(F.lit(0.0))
