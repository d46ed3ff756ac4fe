"""Pixel tables: grid alignment, masked indices and zonal statistics."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.config import INDEX_NAMES, MASKED_SCL
from furrow.functions.spectral import all_indices, hidden

ZONE = ("tile", "date", "parcel_id")
#: A zone's sums and counts take about so many times the bytes of a pixel's bands.
SUMS_TO_PIXEL = 4
#: Hashed lots of zones; one with so many times the mean's pixels, and so many at least, holds a large zone.
LOTS, LARGE_LOT, LARGE_LOT_PX = 4096, 4, 20_000


def align_to_fine_grid(coarse: DataFrame, fine: DataFrame, factor: int = 2, keys: Sequence[str] = ("tile", "date")) -> DataFrame:
    """Give every fine pixel the values of the coarse pixel it lies in."""
    at = fine.withColumns(
        {"_r": F.floor(F.col("row_no") / factor), "_c": F.floor(F.col("col_no") / factor)}
    )
    source = coarse.withColumnsRenamed({"row_no": "_r", "col_no": "_c"})
    return at.join(source, [*keys, "_r", "_c"]).drop("_r", "_c")


def masked_indices(pixels: DataFrame, indices: Iterable[str] = INDEX_NAMES, masked=MASKED_SCL) -> DataFrame:
    """Add the index columns; NULL where the pixel shows no ground."""
    exprs = all_indices()
    blind = F.coalesce(hidden(masked=masked), F.lit(False))
    return pixels.withColumns({i: F.when(~blind, exprs[i]) for i in indices})


def zonal_stats(pixels: DataFrame, indices: Iterable[str] = INDEX_NAMES, keys: Sequence[str] = ZONE, expected: DataFrame | None = None) -> DataFrame:
    """Mean and count of every index per parcel, all in one pass over the pixels.

    ``pixels`` has index columns and the parcel of each pixel. ``expected`` lists the keys that
    must appear even without pixels (mean NULL, count 0).
    """
    indices = list(indices)
    aggs = []
    for i in indices:
        aggs += [F.avg(i).alias(f"{i.lower()}_mean"), F.count(i).alias(f"{i.lower()}_count")]
    out = pixels.where(F.col("parcel_id").isNotNull()).groupBy(*keys).agg(*aggs)
    return out if expected is None else with_expected(out, expected, indices, keys)


def _large_lots(pixels: DataFrame, keys: Sequence[str]) -> list[int] | None:
    """Lots of zones with far more pixels than others; None if combining within the partitions makes all pixels few enough."""
    zone = F.xxhash64(*keys)
    parts = pixels.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(zone).alias("zones"))
    found = parts.agg(F.sum("n").alias("n"), F.sum("zones").alias("zones")).first()
    if not found["n"] or found["zones"] * SUMS_TO_PIXEL <= found["n"]:
        return None
    least = max(LARGE_LOT_PX, LARGE_LOT * found["n"] / LOTS)
    lots = pixels.groupBy(F.pmod(zone, F.lit(LOTS)).alias("lot")).count().where(F.col("count") > least)
    return [r["lot"] for r in lots.collect()]  # LOTS / LARGE_LOT at most


def zonal_indices(pixels: DataFrame, indices: Iterable[str] = INDEX_NAMES, keys: Sequence[str] = ZONE, expected: DataFrame | None = None, judged: DataFrame | None = None) -> DataFrame:
    """``zonal_stats`` of the masked indices of ``pixels``, which have bands.

    Where zones have few pixels in a partition, the pixels' bands are shuffled by zone and not the zones' sums, which are wider; pixels of large zones are
    combined first all the same, so none of them meets in a task. ``judged`` is the table that decides this (``pixels`` if not given).
    """
    indices = list(indices)
    kept = pixels.where(F.col("parcel_id").isNotNull())
    large = _large_lots((pixels if judged is None else judged).where(F.col("parcel_id").isNotNull()), keys)
    if large is None:
        return zonal_stats(masked_indices(kept, indices), indices, keys, expected)
    inside = F.pmod(F.xxhash64(*keys), F.lit(LOTS)).isin(large)
    out = zonal_stats(masked_indices((kept.where(~inside) if large else kept).repartition(*keys), indices), indices, keys)
    if large:
        out = out.unionByName(zonal_stats(masked_indices(kept.where(inside), indices), indices, keys))
    return out if expected is None else with_expected(out, expected, indices, keys)


def with_expected(zones: DataFrame, expected: DataFrame, indices: Sequence[str], keys: Sequence[str] = ZONE) -> DataFrame:
    """The zones of ``expected``, with mean NULL and count 0 where they have no pixels."""
    full = expected.select(*keys).join(zones, list(keys), "left")
    return full.withColumns({f"{i.lower()}_count": F.coalesce(f"{i.lower()}_count", F.lit(0)) for i in indices})


def min_zone_px(zones: DataFrame, n: int, ref: str = "ndvi") -> DataFrame:
    """Parcels with enough usable pixels, judged on one index."""
    return zones.where(F.coalesce(F.col(f"{ref}_count"), F.lit(0)) >= n) if n > 0 else zones
