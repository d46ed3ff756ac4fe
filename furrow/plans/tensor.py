"""Labelled long table to regular per-parcel arrays with splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.config import MISSING_GROUP, TensorParams
from furrow.operators.aggregate import bin_aggregate, parcel_texts, quality_columns
from furrow.operators.encode import encode_labels, label_dictionary
from furrow.operators.reshape import index_columns, index_list
from furrow.operators.splits import create_splits
from furrow.operators.timegrid import bin_dates, grid_dates, observed, to_tensor
from furrow.session import cut_lineage
from furrow.sources.prepared import Prepared
from furrow.sources.readers import clean_training


def step_rows(binned: DataFrame, features: list[str]) -> DataFrame:
    """One row per observed (parcel, date): features and quality, in one aggregation."""
    return binned.groupBy("parcel_id", "date").agg(*index_columns(features, "value_mean"), *quality_columns())


def prepare(training: DataFrame, p: TensorParams = TensorParams(), clean: bool = True) -> Prepared:
    """The whole path: clean, bin, aggregate, arrange on the grid, encode, filter, split.

    Labels are encoded before short series are dropped, so a class that loses all its parcels
    keeps its id.
    """
    rows = clean_training(training, p.indices, p.min_px, p.max_cloud) if clean else training
    grouped = "label_group" in rows.columns
    # One exchange by parcel serves the step rows, the arrays and the parcel texts.
    binned = cut_lineage(bin_aggregate(bin_dates(rows, p.frequency), grouped).repartition("parcel_id"))
    features, dates = index_list(binned), grid_dates(binned, p.frequency)

    texts = parcel_texts(binned, ["label", "tile"] + (["label_group"] if grouped else []))
    labels = label_dictionary(texts)
    encoded = encode_labels(texts)
    if grouped:
        groups = label_dictionary(texts, "label_group", "group_id")
        encoded = encode_labels(encoded, "label_group", "group_id")
    else:
        groups = texts.sparkSession.createDataFrame([], "label_group string, group_id int")
        encoded = encoded.withColumn("group_id", F.lit(MISSING_GROUP))

    steps = step_rows(binned, features)
    # Dates outside the grid (days a regular grid skips) are not part of the arrays.
    on_grid = steps.where(F.col("date").isin(*dates) & observed(features))
    enough = on_grid.groupBy("parcel_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= p.min_obs)
    ids = encoded.join(enough.select("parcel_id"), "parcel_id", "left_semi")
    ids = cut_lineage(ids.select("parcel_id", "label_id", "group_id", "tile"))
    split = create_splits(ids, p.split_method, test=p.test_size, val=p.val_size, seed=p.seed, stratify=p.stratify, label="label_id")
    arrays = to_tensor(steps, features, dates, p.fill_value)
    out = arrays.join(split, "parcel_id").withColumns({c: F.col(c).cast("int") for c in ("label_id", "group_id")})
    return Prepared(out, features, dates, labels, groups)
