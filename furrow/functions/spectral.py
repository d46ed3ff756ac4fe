"""Spectral index expressions over raw band values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow.config import MASKED_SCL

# Fixed value: guard against a zero denominator.
EPS = 1e-6


def _ratio(top: Column, bottom: Column) -> Column:
    # Plain IEEE division would give NaN on 0/0; a NULL cell is this engine's missing value.
    return F.try_divide(top, bottom + F.lit(EPS))


def ndvi(nir: Column, red: Column) -> Column:
    return _ratio(nir - red, nir + red)


def ndmi(nir: Column, swir: Column) -> Column:
    return _ratio(nir - swir, nir + swir)


def ndwi(green: Column, nir: Column) -> Column:
    return _ratio(green - nir, green + nir)


def evi(nir: Column, red: Column, blue: Column) -> Column:
    return _ratio(2.5 * (nir - red), nir + 6.0 * red - 7.5 * blue + 1.0)


def gndvi(nir: Column, green: Column) -> Column:
    return _ratio(nir - green, nir + green)


def savi(nir: Column, red: Column) -> Column:
    return _ratio(1.5 * (nir - red), nir + red + 0.5)


def osavi(nir: Column, red: Column) -> Column:
    return _ratio(1.16 * (nir - red), nir + red + 0.16)


def msavi(nir: Column, red: Column) -> Column:
    base = 2.0 * nir + 1.0
    return 0.5 * (base - F.sqrt(F.greatest(base * base - 8.0 * (nir - red), F.lit(0.0))))


def mndwi(green: Column, swir: Column) -> Column:
    return _ratio(green - swir, green + swir)


def arvi(nir: Column, red: Column, blue: Column) -> Column:
    haze = 2.0 * red - blue
    return _ratio(nir - haze, nir + haze)


def bsi(swir: Column, red: Column, nir: Column, blue: Column) -> Column:
    return _ratio((swir + red) - (nir + blue), (swir + red) + (nir + blue))


def all_indices(nir="nir", red="red", green="green", blue="blue", swir="swir") -> dict[str, Column]:
    """Every index by name, in export order, over the named band columns."""
    n, r, g, b, s = (F.col(c).cast("double") for c in (nir, red, green, blue, swir))
    return {
        "NDVI": ndvi(n, r),
        "NDMI": ndmi(n, s),
        "NDWI": ndwi(g, n),
        "EVI": evi(n, r, b),
        "GNDVI": gndvi(n, g),
        "SAVI": savi(n, r),
        "OSAVI": osavi(n, r),
        "MSAVI": msavi(n, r),
        "MNDWI": mndwi(g, s),
        "ARVI": arvi(n, r, b),
        "BSI": bsi(s, r, n, b),
    }


def hidden(nir="nir", red="red", scl="scl", masked=MASKED_SCL) -> Column:
    """True where a pixel carries no ground signal."""
    return ((F.col(nir) == 0) & (F.col(red) == 0)) | F.col(scl).isin(*masked)
