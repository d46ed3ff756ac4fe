"""Pivots and unpivots between long and wide feature layouts.

Value lists are bounded by the calendar and the index names; they are passed in, or read once.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.text import feature_name

PHENOLOGY_STATS = ("mean", "std", "min", "max", "median", "amp", "doy_peak", "doy_trough", "auc")


def index_list(df: DataFrame) -> list[str]:
    return sorted(r[0] for r in df.select("idx").distinct().collect())


def date_list(df: DataFrame) -> list:
    return sorted(r[0] for r in df.select("date").distinct().collect())


def feature_list(agg: DataFrame) -> list[str]:
    """``idx__date`` names that occur, sorted by name."""
    rows = agg.select(feature_name("idx", "date").alias("f")).distinct().collect()
    return sorted(r["f"] for r in rows)


def pivot_index_date(agg: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """One ``idx__date`` column per feature that occurs."""
    features = list(features) if features is not None else feature_list(agg)
    named = agg.select("parcel_id", feature_name("idx", "date").alias("feature"), "value")
    return named.groupBy("parcel_id").pivot("feature", features).agg(F.avg("value"))


def index_columns(indices: Iterable[str], value: str = "value") -> list[Column]:
    return [F.avg(F.when(F.col("idx") == i, F.col(value))).alias(i) for i in indices]


def pivot_index(agg: DataFrame, indices: Iterable[str] | None = None, keys: Sequence[str] = ("parcel_id", "date"), value: str = "value") -> DataFrame:
    """One column per index. Conditional means keep it a single hash aggregation."""
    names = list(indices) if indices is not None else index_list(agg)
    return agg.groupBy(*keys).agg(*index_columns(names, value))


def date_index_names(dates: Iterable, indices: Iterable[str]) -> list[str]:
    indices = list(indices)
    return [f"{d}__{i}" for d in dates for i in indices]


def pivot_date_index(agg: DataFrame, dates: Iterable, indices: Iterable[str]) -> DataFrame:
    """The complete date-major product of ``date__idx`` columns, present in the data or not."""
    named = agg.select("parcel_id", feature_name("date", "idx").alias("feature"), "value")
    return named.groupBy("parcel_id").pivot("feature", date_index_names(dates, indices)).agg(F.avg("value"))


def pivot_phenology(stats: DataFrame, indices: Iterable[str] | None = None) -> DataFrame:
    """One ``idx__stat`` column per index and statistic."""
    names = list(indices) if indices is not None else index_list(stats)
    return stats.groupBy("parcel_id").agg(
        *[F.max(F.when(F.col("idx") == i, F.col(s))).alias(f"{i}__{s}") for s in PHENOLOGY_STATS for i in names]
    )


def unpivot_zonal(wide: DataFrame, indices: Iterable[str], keys: Sequence[str]) -> DataFrame:
    """(``x_mean``, ``x_count``) column pairs to long observation rows."""
    pairs = [
        F.struct(
            F.lit(i).alias("idx"),
            F.col(f"{i.lower()}_mean").alias("value_mean"),
            F.col(f"{i.lower()}_count").cast("int").alias("px_count"),
        )
        for i in indices
    ]
    return wide.select(*keys, F.explode(F.array(*pairs)).alias("_p")).select(*keys, "_p.*")


def long_features(wide: DataFrame, names: Iterable[str], key: str = "parcel_id") -> DataFrame:
    """Wide features back to (key, feature, value)."""
    cells = [F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").cast("double").alias("value")) for n in names]
    return wide.select(key, F.explode(F.array(*cells)).alias("_c")).select(key, "_c.*")


def concat_history(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two training phases in one table; the second continues the epoch numbers of the first."""
    offset = first.count()
    shifted = second.withColumn("epoch", F.col("epoch") + F.lit(float(offset)))
    return first.unionByName(shifted, allowMissingColumns=True).orderBy("epoch")


def canonical_order(df: DataFrame, within: bool = True) -> DataFrame:
    """Rows by parcel, date and index; globally only when asked for."""
    keys = ["parcel_id", "date", "idx"]
    return df.sortWithinPartitions(*keys) if within else df.orderBy(*keys)
