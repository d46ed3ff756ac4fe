"""Long observations to a feature table for tree models, and to season summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.config import TabularParams
from furrow.operators.aggregate import weighted_mean
from furrow.operators.clean import drop_missing, keep_indices, labelled_only, max_cloud, min_class_count, min_px
from furrow.operators.encode import encode_labels
from furrow.operators.gapfill import date_positions, impute_median, interpolate, interpolate_interleaved
from furrow.operators.joins import add_phenology, join_features
from furrow.operators.phenology import drop_padding, phenology, temporal_summary
from furrow.operators.quantiles import exact_median
from furrow.operators.reshape import (
    date_list,
    feature_list,
    long_features,
    pivot_date_index,
    pivot_index,
    pivot_index_date,
    pivot_phenology,
)
from furrow.operators.splits import stratified_split
from furrow.operators.timegrid import limit_dates
from furrow.session import cut_lineage


def cells(obs: DataFrame, labels: DataFrame, p: TabularParams) -> DataFrame:
    """Filtered, pixel-weighted (parcel, date, index) cells of labelled parcels.

    The parcel filter runs after the aggregation: its key is part of the grouping keys, and far
    fewer rows are left by then.
    """
    rows = drop_missing(obs, ["date", "parcel_id", "idx", "value_mean", "px_count", "cloud_scene"])
    rows = min_px(max_cloud(keep_indices(rows, p.indices), p.max_cloud), p.min_px)
    # Read by every later step, some of them several times: write it once.
    return cut_lineage(limit_dates(labelled_only(weighted_mean(rows), labels), p.max_dates))


def targets(agg: DataFrame, labels: DataFrame, p: TabularParams) -> DataFrame:
    """Parcels with cells, in classes that are large enough, with class id and split."""
    seen = labels.join(agg.select("parcel_id").distinct(), "parcel_id", "left_semi")
    kept = cut_lineage(encode_labels(min_class_count(seen, p.min_class_count)))
    return cut_lineage(stratified_split(kept, "label", p.test_size, p.seed))


def impute_wide(df: DataFrame, cols: list[str], fit_on: str = "train") -> DataFrame:
    """Fill NULLs of wide columns by the exact column median of the fitting rows."""
    fit = df if fit_on == "all" else df.where(F.col("split") == "train")
    medians = exact_median(long_features(fit, cols), ["feature"], "value").collect()
    return df.fillna({r["feature"]: r["median"] for r in medians}) if medians else df


def feature_table(agg: DataFrame, kept: DataFrame, p: TabularParams) -> DataFrame:
    """Wide features of the kept parcels: filled series, then phenology if asked for.

    The cells are distributed by parcel once, before the join: whichever join Spark picks, gap
    filling and phenology then group by the parcel (and more) without another exchange.
    """
    own = agg.repartition("parcel_id").join(kept.select("parcel_id", "split"), "parcel_id")
    fit = None if p.fit_on == "all" else "train"
    if p.fill == "interleaved":
        dates = date_list(agg)
        filled = interpolate_interleaved(own, dates, p.indices)
        wide = pivot_date_index(filled, dates, p.indices)
    else:
        filled = interpolate(own, date_positions(agg))
        train = filled.join(kept.where(F.col("split") == "train").select("parcel_id"), "parcel_id", "left_semi") if fit else None
        wide = pivot_index_date(impute_median(filled, train), feature_list(agg))
    out = join_features(kept, wide)
    if p.phenology:
        stats = pivot_phenology(phenology(own), p.indices)
        out = impute_wide(add_phenology(out, stats), [c for c in stats.columns if c != "parcel_id"], p.fit_on)
    return out


def season_table(agg: DataFrame, kept: DataFrame, p: TabularParams) -> DataFrame:
    """Season summaries of the interleaved series without its padding dates."""
    own = agg.join(kept.select("parcel_id"), "parcel_id", "left_semi")
    filled = interpolate_interleaved(own, date_list(agg), p.indices)
    rows = drop_padding(pivot_index(filled, p.indices), p.indices)
    return join_features(kept, temporal_summary(rows, p.indices))
