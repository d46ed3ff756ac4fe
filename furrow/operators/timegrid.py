"""Time bins, the regular time grid and per-parcel arrays on it."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.arrays import bind

# Calendar units a frequency code stands for; their bins start with the unit.
CALENDAR_UNITS = {"W": "week", "M": "month", "MS": "month", "Q": "quarter", "QS": "quarter", "Y": "year", "YS": "year"}


def day_step(freq: str) -> int | None:
    """Number of days of an ``nD`` frequency."""
    match = re.fullmatch(r"(\d+)[dD]", freq.strip())
    if match is None:
        return None
    if int(match.group(1)) == 0:
        raise ValueError(f"invalid day frequency: {freq}")
    return int(match.group(1))


def window_start(date: Column, start: Column, days: int = 5) -> Column:
    """Start of the ``days``-long window, counted from ``start``, that holds ``date``."""
    steps = F.floor(F.datediff(date, start) / F.lit(days)).cast("int")
    return F.date_add(start, steps * days)


def bin_dates(df: DataFrame, freq: str | None, c: str = "date") -> DataFrame:
    """Replace dates by their bin start. Day bins are anchored at the earliest date of the data."""
    if not freq or not freq.strip():
        return df
    step = day_step(freq)
    if step is None:
        unit = CALENDAR_UNITS.get(freq.strip().upper())
        if unit is None:
            raise ValueError(f"unknown frequency: {freq}")
        return df.withColumn(c, F.date_trunc(unit, c).cast("date"))
    first = df.agg(F.min(c)).first()[0]
    return df.withColumn(c, window_start(F.col(c), F.lit(first), step))


def time_grid(df: DataFrame, freq: str | None = None) -> DataFrame:
    """The grid dates with their position ``t``: a regular day grid, or the dates that occur."""
    if not freq:
        dates = df.agg(F.array_sort(F.collect_set("date")).alias("g"))
    else:
        step = day_step(freq)
        if step is None:
            raise ValueError("only day grids are regular; calendar bins do not align with their range")
        dates = df.agg(F.sequence(F.min("date"), F.max("date"), F.make_dt_interval(F.lit(step))).alias("g"))
    return dates.select(F.posexplode("g").alias("t", "date"))


def grid_dates(df: DataFrame, freq: str | None = None) -> list:
    """The same as a list; a calendar bounds it."""
    dates = [r["date"] for r in time_grid(df, freq).orderBy("t").collect()]
    if not dates:
        raise ValueError("the time grid is empty")
    return dates


def observed(features: Iterable[str]) -> Column:
    return F.coalesce(*[F.col(f) for f in features]).isNotNull()


def to_tensor(cells: DataFrame, features: Sequence[str], dates: Sequence, fill: float = 0.0) -> DataFrame:
    """Ordered per-parcel arrays over the grid from sparse (parcel, date) rows.

    Rows carry the feature columns, ``cloud_scene`` and ``px_count``. Only observed rows are
    exchanged; the empty grid slots are filled in after grouping.
    """
    grid = F.array(*[F.lit(d) for d in dates])
    t = (F.array_position(grid, F.col("date")) - 1).cast("int")
    default = F.lit(float(fill)).cast("float")
    slot = F.struct(
        F.array(*[F.coalesce(F.col(f).cast("float"), default) for f in features]).alias("f"),
        observed(features).alias("o"),
        F.least(F.greatest(F.coalesce(F.col("cloud_scene"), F.lit(100.0)), F.lit(0.0)), F.lit(100.0)).cast("float").alias("c"),
        F.greatest(F.coalesce(F.col("px_count").cast("double"), F.lit(0.0)), F.lit(0.0)).cast("float").alias("p"),
    )
    empty = F.struct(
        F.array(*[default] * len(features)).alias("f"),
        F.lit(False).alias("o"),
        F.lit(100.0).cast("float").alias("c"),
        F.lit(0.0).cast("float").alias("p"),
    )
    rows = cells.select("parcel_id", t.alias("t"), slot.alias("s")).where("t >= 0")
    steps = F.sequence(F.lit(0), F.lit(len(dates) - 1))
    # Bound, because a lambda would rebuild the map at every step.
    dense = bind(
        F.map_from_entries(F.col("_m")), lambda m: F.transform(steps, lambda i: F.coalesce(F.try_element_at(m, i), empty))
    )
    return (
        rows.groupBy("parcel_id")
        .agg(F.collect_list(F.struct("t", "s")).alias("_m"))
        .select("parcel_id", dense.alias("_s"))
        .select(
            "parcel_id",
            F.col("_s.f").alias("features"),
            F.transform(grid, lambda d: F.dayofyear(d).cast("smallint")).alias("doy"),
            F.col("_s.o").alias("observed"),
            F.col("_s.c").alias("cloud"),
            F.col("_s.p").alias("px"),
        )
    )


def from_tensor(prepared: DataFrame, features: Sequence[str], keep: Iterable[str] = ()) -> DataFrame:
    """One row per (parcel, t) again."""
    slots = F.arrays_zip("features", "doy", "observed", "cloud", "px")
    return (
        prepared.select("parcel_id", *keep, F.posexplode(slots).alias("t", "_s"))
        .select(
            "parcel_id",
            *keep,
            "t",
            F.col("_s.doy").alias("doy"),
            F.col("_s.observed").alias("observed"),
            F.col("_s.cloud").alias("cloud_scene"),
            F.col("_s.px").alias("px_count"),
            *[F.get(F.col("_s.features"), F.lit(i)).cast("double").alias(f) for i, f in enumerate(features)],
        )
    )


def masked_pool(cells: DataFrame, features: Iterable[str], reliability: str | None = None) -> DataFrame:
    """Mean of the features over observed steps, optionally weighted by reliability (at least 0.05)."""
    weight = F.col("observed").cast("double")
    if reliability is not None:
        weight = weight * F.greatest(F.col(reliability), F.lit(0.05))
    total = F.greatest(F.sum(weight), F.lit(1.0))
    return cells.groupBy("parcel_id").agg(*[(F.sum(F.col(f) * weight) / total).alias(f) for f in features])


def limit_dates(agg: DataFrame, n: int) -> DataFrame:
    """Rows of the n dates seen on most parcels (all if n <= 0); earlier dates win ties."""
    if n <= 0:
        return agg
    counts = agg.groupBy("date").agg(F.count_distinct("parcel_id").alias("_n"))
    kept = counts.orderBy(F.desc("_n"), "date").limit(n).select("date")
    return agg.join(F.broadcast(kept), "date", "left_semi")
