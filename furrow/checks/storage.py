"""Queries that write the given tables and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.checks import views as v
from furrow.checks.cleaning import OBS
from furrow.checks.registry import check
from furrow.checks.scoring import SCALARS, per_class
from furrow.checks.views import r6
from furrow.config import TensorParams
from furrow.operators import evaluate, timegrid
from furrow.plans.tensor import prepare
from furrow.session import scratch_path
from furrow.sources import prepared, readers, runs, writers


@check("s4_write_parquet", "obs", f"SELECT {OBS} FROM obs")
def _(spark, sf):
    path = scratch_path(spark)
    writers.write_parquet(v.obs(spark, sf), path)
    return readers.read_observations(spark, path, "parquet")


@check("s5_write_csv", "obs", f"SELECT {OBS} FROM obs")
def _(spark, sf):
    path = scratch_path(spark)
    writers.write_csv(v.obs(spark, sf), path)
    return readers.read_observations(spark, path, "csv")


@check("s6_append_training", "training", f"SELECT {OBS}, label, label_group FROM training")
def _(spark, sf):
    path = scratch_path(spark)
    rows = v.training(spark, sf)
    writers.append_training(rows.where("cloud_scene <= 40"), path, "clear")
    for _ in range(2):  # a batch that is tried again adds nothing
        writers.append_training(rows.where("cloud_scene > 40"), path, "cloudy")
    cols = ["date", "tile", "parcel_id", "idx", "value_mean", "px_count", "cloud_scene", "label", "label_group"]
    return spark.read.parquet(path).select(*cols)


@check("s7_write_json", "preds", f"WITH {per_class('preds', 'split')} SELECT split, {SCALARS} FROM pc GROUP BY split")
def _(spark, sf):
    path = scratch_path(spark)
    scores = evaluate.scalar_metrics(v.preds(spark, sf), by=["split"])
    writers.write_json(scores.select("split", F.struct(*scores.columns[1:]).alias("scores")), path)
    return spark.read.json(path).select("split", "scores.*")


@check(
    "s8_prepared_round_trip",
    "cells",
    "SELECT parcel_id, t, dayofyear(date) AS doy, observed, " + ", ".join(r6(f'cast("{c}" AS float)', f'"{c}"') for c in ("cloud_scene", "px_count", "CLICK", "VIEW")) + " FROM cells",
)
def _(spark, sf):
    path = scratch_path(spark)
    prepared.save_prepared(prepare(v.training(spark, sf), TensorParams(indices=None, min_obs=1)), path)
    back = prepared.load_prepared(spark, path)
    rows = timegrid.from_tensor(back.rows, back.features)
    return rows.select("parcel_id", "t", "doy", "observed", "cloud_scene", "px_count", "CLICK", "VIEW")


@check(
    "s12_collect_runs",
    "preds",
    f"""WITH {per_class('preds', 'split')} SELECT split AS run, {r6('sum(tp) / sum(support)', 'accuracy')}, {r6('avg(f1)', 'f1_macro')},
    {r6('sum(f1 * support) / sum(support)', 'f1_weighted')} FROM pc GROUP BY split""",
)
def _(spark, sf):
    path = scratch_path(spark)
    scores = evaluate.scalar_metrics(v.preds(spark, sf), by=["split"]).drop("n")
    scores.select(F.col("split").alias("run"), *scores.columns[1:]).coalesce(1).write.partitionBy("run").json(path)
    found = runs.collect_runs(spark, f"{path}/*/*.json")
    return found.select(F.element_at(F.split("run", "="), -1).alias("run"), "accuracy", "f1_macro", "f1_weighted")
