"""Aggregations of observations and dictionaries."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.text import mode_text, normalize_id, strip
from furrow.operators.quantiles import exact_quantiles

CELL = ("parcel_id", "date", "idx")


def weighted_mean(obs: DataFrame, keys: Iterable[str] = CELL) -> DataFrame:
    """Pixel-weighted mean per key; both sums combine map-side."""
    px = F.col("px_count").cast("double")
    value = F.try_divide(F.sum(F.col("value_mean") * px), F.sum(px))
    return obs.groupBy(*keys).agg(value.alias("value"))


def bin_aggregate(obs: DataFrame, group: bool = True) -> DataFrame:
    """Unweighted means and most frequent texts per (parcel, date, index)."""
    texts = ["tile", "label"] + (["label_group"] if group else [])
    return obs.groupBy(*CELL).agg(
        F.avg("value_mean").alias("value_mean"),
        F.avg("cloud_scene").alias("cloud_scene"),
        F.avg("px_count").alias("px_count"),
        *[mode_text(c).alias(c) for c in texts],
    )


def quality_columns() -> list[Column]:
    return [F.avg("cloud_scene").alias("cloud_scene"), F.avg("px_count").alias("px_count")]


def quality_by_date(obs: DataFrame) -> DataFrame:
    return obs.groupBy("parcel_id", "date").agg(*quality_columns())


def parcel_texts(obs: DataFrame, cols: Iterable[str] = ("label", "tile", "label_group")) -> DataFrame:
    return obs.groupBy("parcel_id").agg(*[mode_text(c).alias(c) for c in cols])


def consolidate_labels(raw: DataFrame, group: str | None = None) -> DataFrame:
    """One row per parcel: most frequent label, smallest on ties.

    Rows are counted per (parcel, text) first, which combines map-side, so a parcel with very
    many rows reaches the last step as a handful of counts.
    """
    rows = raw.where(F.col("parcel_id").isNotNull() & F.col("label").isNotNull()).select(
        normalize_id("parcel_id").alias("parcel_id"),
        strip("label").alias("label"),
        *([F.coalesce(strip(group), F.lit("")).alias("label_group")] if group else []),
    )
    rows = rows.where(F.col("label") != "")

    def winner(c: str) -> DataFrame:
        counts = rows.groupBy("parcel_id", c).agg(F.count(F.lit(1)).alias("_n"))
        votes = F.when(F.col(c) != "", F.struct((-F.col("_n")).alias("n"), F.col(c).alias("v")))
        return counts.groupBy("parcel_id").agg(F.coalesce(F.min(votes)["v"], F.lit("")).alias(c))

    out = winner("label")
    return out.join(winner("label_group"), "parcel_id") if group else out


def first_label(labels: DataFrame, seq: str = "input_seq") -> DataFrame:
    """The label that comes first in input order, per parcel."""
    return labels.groupBy("parcel_id").agg(F.min_by("label", seq).alias("label"))


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label)


def top_classes(df: DataFrame, n: int = 20, label: str = "label") -> DataFrame:
    return class_counts(df, label).limit(n)


def parcels_per_date(agg: DataFrame) -> DataFrame:
    return agg.groupBy("date").agg(F.count_distinct("parcel_id").alias("n_parcels"))


def describe_exact(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles and max, one row per column."""
    cols = list(cols)
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols])
        ).alias("_c")
    ).select("_c.column", "_c.v")
    stats = long.groupBy("column").agg(
        F.count("v").alias("count"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    quartiles = exact_quantiles(long, ["column"], "v", [0.25, 0.5, 0.75])
    wide = quartiles.groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(f"q{round(p * 100)}") for p in (0.25, 0.5, 0.75)]
    )
    return stats.join(wide, "column", "left").select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def index_correlation(wide: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Pearson matrix, pairwise complete, in one pass: one row per ordered pair."""
    cols = list(cols)
    pairs = [(a, a) for a in cols] + list(combinations(cols, 2))
    row = wide.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = [(a, b, f"{a}|{b}") for a, b in pairs] + [(b, a, f"{a}|{b}") for a, b in pairs if a != b]
    return row.select(
        F.explode(
            F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{c}`").alias("corr")) for a, b, c in cells])
        ).alias("_c")
    ).select("_c.*")


def missing_ratio(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Mean over the columns of each column's share of NULLs."""
    cols = list(cols)
    shares = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    total = F.aggregate(F.array(*[f"c{i}" for i in range(len(cols))]), F.lit(0.0), lambda acc, v: acc + v)
    return shares.select((total / len(cols)).alias("missing_ratio"))


def missing_ratio_long(cells: DataFrame, slots: int) -> DataFrame:
    """The same on a long table, of which ``slots`` (index, date) features are expected per parcel."""
    return cells.agg(
        (1.0 - F.count("value") / (F.count_distinct("parcel_id") * F.lit(slots))).alias("missing_ratio")
    )


def mean_curve(obs: DataFrame) -> DataFrame:
    return obs.groupBy("date", "idx").agg(F.avg("value_mean").alias("mean_value"))


def reconstruction_error(cells: DataFrame, loss: str = "mse") -> DataFrame:
    """Errors over masked cells: one row per (parcel, t, feature) with target and predicted."""
    if loss not in ("mse", "l1"):
        raise ValueError(f"unknown loss: {loss}")
    gap = F.col("predicted") - F.col("target")
    mse, mae = F.avg(gap * gap), F.avg(F.abs(gap))
    return cells.where("masked").agg(
        (mse if loss == "mse" else mae).alias("loss"),
        mae.alias("mae"),
        F.sqrt(mse).alias("rmse"),
        F.count_distinct("parcel_id", "t").alias("masked_tokens"),
    )


def fold_summary(runs: DataFrame, score: str = "score") -> DataFrame:
    """Mean and population std of the folds that have a score."""
    return runs.agg(
        F.count(score).alias("n_folds"),
        F.avg(score).alias("score_mean"),
        F.stddev_pop(score).alias("score_std"),
    )


def profile(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.count_distinct("parcel_id").alias("n_parcels"),
    )


def total_bounds(boxes: DataFrame) -> DataFrame:
    return boxes.agg(
        F.min("minx").alias("minx"),
        F.min("miny").alias("miny"),
        F.max("maxx").alias("maxx"),
        F.max("maxy").alias("maxy"),
    )
