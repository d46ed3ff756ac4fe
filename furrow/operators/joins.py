"""Joins between observations, labels and feature tables.

Label and feature tables have one row per parcel and grow with the data: nothing here forces a
broadcast. Spark broadcasts them only below its own size threshold and otherwise runs a shuffle
join, whose hot parcels AQE splits.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_features(labels: DataFrame, wide: DataFrame) -> DataFrame:
    return labels.join(wide, "parcel_id", "inner")


def add_phenology(df: DataFrame, phenology: DataFrame) -> DataFrame:
    return df.join(phenology, "parcel_id", "left")


def attach_label(obs: DataFrame, labels: DataFrame) -> DataFrame:
    return obs.join(labels.select("parcel_id", "label"), "parcel_id", "inner")


def attach_group(obs: DataFrame, labels: DataFrame) -> DataFrame:
    """Group name, '' where the parcel has none."""
    joined = obs.join(labels.select("parcel_id", "label_group"), "parcel_id", "left")
    return joined.withColumn("label_group", F.trim(F.coalesce("label_group", F.lit(""))))


def explore_join(obs: DataFrame, labels: DataFrame) -> DataFrame:
    """Many-to-many join: repeated labels fan out."""
    return obs.join(labels, "parcel_id", "inner")


def densify(df: DataFrame, dates: Iterable, keys: DataFrame | None = None) -> DataFrame:
    """One row per parcel and grid date, NULLs where nothing was observed.

    The grid is a literal array, so the expansion is a projection and needs no cross join.
    """
    parcels = keys if keys is not None else df.select("parcel_id").distinct()
    grid = F.array(*[F.lit(d) for d in dates])
    slots = parcels.select("parcel_id", F.posexplode(grid).alias("t", "date"))
    return slots.join(df, ["parcel_id", "date"], "left")


def concat(parts: Iterable[DataFrame]) -> DataFrame:
    parts = list(parts)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
