"""Scene catalogue: search, windows and selection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.config import BANDS, MAX_SEARCH_CLOUD, TOP_K_PER_WINDOW, WINDOW_DAYS
from furrow.operators.timegrid import window_start


def search_scenes(scenes: DataFrame, start, end, bbox: tuple | None = None, max_cloud: float = MAX_SEARCH_CLOUD) -> DataFrame:
    """Scenes of a date range and box below the cloud limit that belong to a tile.

    Plain comparisons, so they reach the scan.
    """
    out = scenes.where(
        F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        & (F.col("cloud") < max_cloud)
        & (F.col("tile") != "")
    )
    if bbox is not None:
        minx, miny, maxx, maxy = bbox
        out = out.where(
            (F.col("minx") <= maxx) & (F.col("maxx") >= minx) & (F.col("miny") <= maxy) & (F.col("maxy") >= miny)
        )
    return out


def require_assets(scenes: DataFrame, bands: Iterable[str] = BANDS) -> DataFrame:
    """Scenes that have every band; one missing band drops the scene."""
    wanted = F.array(*[F.lit(b) for b in bands])
    return scenes.where(F.forall(wanted, lambda b: F.map_contains_key(F.col("assets"), b)))


def scene_keys(scenes: DataFrame, start, days: int = WINDOW_DAYS) -> DataFrame:
    return scenes.withColumn("win", window_start(F.col("date"), F.lit(start).cast("date"), days))


def select_scenes(scenes: DataFrame, start, top_k: int = TOP_K_PER_WINDOW, days: int = WINDOW_DAYS) -> DataFrame:
    """Best scenes per (tile, window): most parcels covered, then least cloud.

    The rank limit is pushed below the exchange, so each task sends at most ``top_k`` rows per key.
    """
    cloud = F.coalesce("cloud", F.lit(100.0))
    order = Window.partitionBy("tile", "win").orderBy(F.desc("coverage"), cloud, "date", "scene_id")
    return (
        scene_keys(scenes.where(F.col("coverage") > 0), start, days)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_k)
    )


def order_scenes(scenes: DataFrame) -> DataFrame:
    return scenes.orderBy("tile", "date", "scene_id")
