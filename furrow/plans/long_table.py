"""Scenes and pixels to the long observation table, and that table joined with labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.config import INDEX_NAMES, SCENE_MIN_PX, TOP_K_PER_WINDOW, WINDOW_DAYS
from furrow.operators.clean import drop_missing, keep_indices, max_cloud, min_class_count, min_px
from furrow.operators.joins import attach_group, attach_label
from furrow.operators.raster import min_zone_px, zonal_indices
from furrow.operators.reshape import unpivot_zonal
from furrow.operators.scenes import require_assets, search_scenes, select_scenes
from furrow.operators.spatial import scene_coverage
from furrow.functions.text import normalize_id, strip
from furrow.session import small_side

# Up to this many picked scenes (a few megabytes) are broadcast to the pixel scan.
MAX_SCENES = 200_000


def pick_scenes(catalogue: DataFrame, parcels: DataFrame, start, end, cell: float = 0.1, exact: bool = True, top_k: int = TOP_K_PER_WINDOW, days: int = WINDOW_DAYS) -> DataFrame:
    """Search, drop incomplete scenes, count parcels, keep the best per tile and window."""
    found = search_scenes(catalogue, start, end)
    picked = select_scenes(scene_coverage(found, parcels, cell, exact), start, top_k, days)
    return require_assets(picked) if "assets" in catalogue.columns else picked


def observe_parcels(pixels: DataFrame, scenes: DataFrame, indices: Iterable[str] = INDEX_NAMES, min_px_count: int = SCENE_MIN_PX) -> DataFrame:
    """Long observations of the picked scenes.

    The scene table, if it is as small as a catalogue selection should be, prunes the pixel scan
    by (tile, date) without moving a pixel; the zonal aggregation shuffles pixels or sums, and
    everything after it works on one row per parcel and scene.
    """
    indices = list(indices)
    picked = small_side(scenes.select("tile", "date", F.coalesce("cloud", F.lit(100.0)).alias("cloud_scene")), MAX_SCENES)
    zones = zonal_indices(pixels.join(picked.select("tile", "date"), ["tile", "date"], "left_semi"), indices, judged=pixels)
    kept = min_zone_px(zones, min_px_count, "ndvi" if "NDVI" in indices else indices[0].lower())
    return unpivot_zonal(kept.join(picked, ["tile", "date"]), indices, ["date", "tile", "parcel_id", "cloud_scene"])


def build_training(obs: DataFrame, labels: DataFrame, indices: Iterable[str] | None = None, max_cloud_scene: float | None = None, min_px_count: int | None = None, min_parcels_per_class: int = 0) -> DataFrame:
    """Labelled long table. ``labels`` has one row per parcel; classes are counted before the join."""
    rows = drop_missing(obs, ["date", "tile", "parcel_id", "idx", "value_mean"])
    rows = rows.withColumns({"parcel_id": normalize_id("parcel_id"), "idx": strip("idx"), "tile": strip("tile")})
    if indices is not None:
        rows = keep_indices(rows, list(indices))
    rows = max_cloud(rows, max_cloud_scene)
    if min_px_count is not None:
        rows = min_px(rows.where(F.col("px_count").isNotNull()), min_px_count)
    if min_parcels_per_class > 0:
        labels = min_class_count(labels, min_parcels_per_class)
    out = attach_label(rows, labels)
    return attach_group(out, labels) if "label_group" in labels.columns else out
