"""Row cleaning and filters of the long observation table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.text import normalize_id, normalize_text, parse_date, strip, to_number
from furrow.session import small_side


def normalize_columns(df: DataFrame, ids: Iterable[str] = (), texts: Iterable[str] = (), uppers: Iterable[str] = ()) -> DataFrame:
    changes = {c: normalize_id(c) for c in ids}
    changes |= {c: normalize_text(c) for c in texts}
    changes |= {c: normalize_text(c, upper=True) for c in uppers}
    return df.withColumns(changes)


def coerce(df: DataFrame, dates: Iterable[str] = (), numbers: Iterable[str] = ()) -> DataFrame:
    """Bad dates and numbers become NULL."""
    return df.withColumns({c: parse_date(c) for c in dates} | {c: to_number(c) for c in numbers})


def require_dates(df: DataFrame, c: str = "date") -> DataFrame:
    """Fail if no row at all has a usable date. One row that has one ends the search."""
    if df.where(F.col(c).isNotNull()).isEmpty() and not df.isEmpty():
        raise ValueError(f"column '{c}' holds no date; use YYYY-MM-DD")
    return df


def drop_missing(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def drop_blank(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    for c in cols:
        df = df.where(strip(c) != "")
    return df


def keep_indices(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.where(F.col("idx").isin(*names))


def absent_indices(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Requested index names that no row has, one row each."""
    wanted = F.array(*[F.lit(n) for n in sorted(names)])
    found = df.where(F.col("idx").isin(*names)).agg(F.collect_set("idx").alias("found"))
    return found.select(F.explode(F.array_except(wanted, F.col("found"))).alias("idx"))


def max_cloud(df: DataFrame, limit: float | None) -> DataFrame:
    """A missing cloud value fails the filter."""
    return df if limit is None else df.where(F.col("cloud_scene") <= limit)


def min_px(df: DataFrame, limit: int) -> DataFrame:
    """A missing pixel count reads as 0; no filter at all for a limit of 0."""
    return df.where(F.coalesce(F.col("px_count"), F.lit(0)) >= limit) if limit > 0 else df


def labelled_only(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of labelled parcels. Labels grow with the data, so Spark picks the join by size."""
    return df.join(labels.select("parcel_id"), "parcel_id", "left_semi")


def min_class_count(df: DataFrame, n: int, label: str = "label") -> DataFrame:
    """Rows of classes that have at least ``n`` rows.

    Counts combine map-side and the surviving classes are a dictionary-size table, so a class
    that holds most rows never meets in one task.
    """
    kept = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select(label)
    return df.join(small_side(kept), label, "left_semi")


def min_obs(cells: DataFrame, n: int) -> DataFrame:
    """Rows of parcels with at least ``n`` observed dates; ``cells`` has one row per (parcel, date)."""
    kept = cells.groupBy("parcel_id").agg(F.count_if(F.col("observed")).alias("_n")).where(F.col("_n") >= n)
    return cells.join(kept.select("parcel_id"), "parcel_id", "left_semi")


def of_label(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col("label") == value)


def model_columns(df: DataFrame, drop: Iterable[str] = (), rename: dict[str, str] | None = None) -> DataFrame:
    return df.drop(*drop).withColumnsRenamed(rename or {})
