"""Linear gap filling and median imputation on long feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators.quantiles import exact_median
from furrow.session import cut_lineage, small_side


def _fill(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Fill ``_slots`` equally spaced positions from the known (``_pos``, ``value``) of a series.

    Every known row produces its own position and the gap up to the next known one; the first
    also covers what lies before it and the last what lies after it. The table is never
    densified before the exchange: only known values are shuffled.
    """
    series = Window.partitionBy(*by).orderBy("_pos")
    known = rows.select(
        *by,
        "_pos",
        "value",
        "_slots",
        F.lag("_pos").over(series).alias("_prev"),
        F.lead("_pos").over(series).alias("_next"),
        F.lead("value").over(series).alias("_next_value"),
    )
    start = F.when(F.col("_prev").isNull(), F.lit(0)).otherwise(F.col("_pos"))
    end = F.coalesce(F.col("_next") - 1, F.col("_slots") - 1)
    slope = (F.col("_next_value") - F.col("value")) / (F.col("_next") - F.col("_pos"))
    value = F.when(
        (F.col("p") > F.col("_pos")) & F.col("_next").isNotNull(),
        F.col("value") + slope * (F.col("p") - F.col("_pos")),
    ).otherwise(F.col("value"))
    return known.withColumn("p", F.explode(F.sequence(start, end))).select(*by, F.col("p").alias("_pos"), value.alias("value"))


def date_positions(agg: DataFrame) -> DataFrame:
    """Position of each date among the dates on which its index occurs."""
    days = agg.select("idx", "date").distinct()
    order = Window.partitionBy("idx").orderBy("date")
    return days.select(
        "idx",
        "date",
        (F.row_number().over(order) - 1).alias("_pos"),
        F.count(F.lit(1)).over(Window.partitionBy("idx")).cast("int").alias("_slots"),
    )


def interpolate(agg: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """Gap fill per (parcel, index) over the date sequence; positions count, not calendar days.

    Dates are equally spaced whatever the days between them, both ends take the nearest value,
    and a (parcel, index) without any value stays absent.
    """
    known = agg.where(F.col("value").isNotNull())
    slots = small_side(positions if positions is not None else date_positions(known))
    filled = _fill(known.join(slots, ["idx", "date"]), ["parcel_id", "idx"])
    return filled.join(slots.drop("_slots"), ["idx", "_pos"]).select("parcel_id", "date", "idx", "value")


def interpolate_interleaved(agg: DataFrame, dates: Sequence, indices: Sequence[str]) -> DataFrame:
    """Compatibility mode: fill across the flattened date-major row of all indices.

    Values bleed between indices; a parcel with any value has all its cells filled.
    """
    spark = agg.sparkSession
    cells = [(d, i, p) for p, (d, i) in enumerate((d, i) for d in dates for i in indices)]
    grid = F.broadcast(spark.createDataFrame(cells, "date date, idx string, _pos int"))
    known = agg.where(F.col("value").isNotNull()).join(grid, ["date", "idx"])
    filled = _fill(known.withColumn("_slots", F.lit(len(cells))), ["parcel_id"])
    return filled.join(grid, "_pos").select("parcel_id", "date", "idx", "value")


def column_medians(cells: DataFrame) -> DataFrame:
    return exact_median(cells, ["idx", "date"], "value")


def impute_median(filled: DataFrame, fit: DataFrame | None = None) -> DataFrame:
    """Add the (parcel, index) series that are wholly absent, from the column medians.

    ``fit`` holds the rows the medians come from (training rows); all rows if not given.
    """
    # Read by the medians (counts, then percentiles), the gaps and the result.
    filled = cut_lineage(filled)
    medians = small_side(column_medians(fit if fit is not None else filled))
    names = medians.agg(F.array_sort(F.collect_set("idx")).alias("_all"))
    absent = (
        filled.groupBy("parcel_id")
        .agg(F.collect_set("idx").alias("_have"))
        .withColumn("_all", names.scalar())
        .select("parcel_id", F.explode(F.array_except("_all", "_have")).alias("idx"))
    )
    added = absent.join(medians, "idx").select("parcel_id", "date", "idx", F.col("median").alias("value"))
    return filled.unionByName(added)
