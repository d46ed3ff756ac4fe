"""Joins of parcels with scene footprints and pixels.

A ring is an array of (x, y) structs. Both sides are spread over a square grid, which turns the
overlap test into an equi join; the exact test runs on the candidates of a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions.arrays import bind

BOX = ("minx", "miny", "maxx", "maxy")


def with_box(df: DataFrame, ring: str = "ring") -> DataFrame:
    x, y = F.col(f"{ring}.x"), F.col(f"{ring}.y")
    return df.withColumns(
        {"minx": F.array_min(x), "miny": F.array_min(y), "maxx": F.array_max(x), "maxy": F.array_max(y)}
    )


def edges(ring: Column) -> Column:
    """Consecutive point pairs; the ring is closed if it is not yet."""
    return F.zip_with(
        ring,
        F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = a["x"] + F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"])
        return ((a["y"] > y) != (b["y"] > y)) & F.coalesce(x < at, F.lit(False))

    return F.size(F.filter(edges(ring), crosses)) % 2 == 1


def _side(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def segments_meet(e: Column, f: Column) -> Column:
    a, b, c, d = e["a"], e["b"], f["a"], f["b"]

    def overlap(k: str) -> Column:
        return (F.least(a[k], b[k]) <= F.greatest(c[k], d[k])) & (F.least(c[k], d[k]) <= F.greatest(a[k], b[k]))

    apart = (_side(a, b, c) * _side(a, b, d) > 0) | (_side(c, d, a) * _side(c, d, b) > 0)
    return overlap("x") & overlap("y") & ~apart


def rings_meet(p: Column, q: Column) -> Column:
    """True if the areas share a point; touching counts."""
    crossing = bind(edges(q), lambda others: F.exists(edges(p), lambda e: F.exists(others, lambda f: segments_meet(e, f))))
    p0, q0 = F.get(p, F.lit(0)), F.get(q, F.lit(0))
    return crossing | point_in_ring(p0["x"], p0["y"], q) | point_in_ring(q0["x"], q0["y"], p)


def _on_grid(df: DataFrame, cell: float) -> DataFrame:
    def span(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)))

    return df.withColumn("_cx", span("minx", "maxx")).withColumn("_cy", span("miny", "maxy"))


def parcels_in_footprint(parcels: DataFrame, scenes: DataFrame, cell: float = 0.1, exact: bool = False) -> DataFrame:
    """(scene, parcel) pairs that intersect.

    Both have box columns; with ``exact`` also a ``ring`` (parcels) and a ``footprint`` (scenes).
    ``cell`` should be near the parcel size or above. A pair that shares several cells is emitted
    only in the cell of its overlap's lower corner, so no distinct is needed.
    """
    p = _on_grid(parcels, cell).alias("p")
    s = _on_grid(scenes, cell).alias("s")
    pairs = p.join(s, (F.col("p._cx") == F.col("s._cx")) & (F.col("p._cy") == F.col("s._cy"))).where(
        (F.col("p.minx") <= F.col("s.maxx"))
        & (F.col("p.maxx") >= F.col("s.minx"))
        & (F.col("p.miny") <= F.col("s.maxy"))
        & (F.col("p.maxy") >= F.col("s.miny"))
        & (F.col("p._cx") == F.floor(F.greatest("p.minx", "s.minx") / cell))
        & (F.col("p._cy") == F.floor(F.greatest("p.miny", "s.miny") / cell))
    )
    if exact:
        pairs = pairs.where(rings_meet(F.col("p.ring"), F.col("s.footprint")))
    return pairs.select("s.scene_id", "p.parcel_id", *[f"p.{c}" for c in BOX])


def crop_boxes(pairs: DataFrame, pad: float = 0.0) -> DataFrame:
    """Box around the parcels of each scene, padded."""
    return pairs.groupBy("scene_id").agg(
        (F.min("minx") - pad).alias("minx"),
        (F.min("miny") - pad).alias("miny"),
        (F.max("maxx") + pad).alias("maxx"),
        (F.max("maxy") + pad).alias("maxy"),
        F.count("parcel_id").alias("n_parcels"),
    )


def scene_coverage(scenes: DataFrame, parcels: DataFrame, cell: float = 0.1, exact: bool = False) -> DataFrame:
    """Scenes with the number of parcels they touch, 0 included."""
    hits = parcels_in_footprint(parcels, scenes, cell, exact).groupBy("scene_id").agg(F.count("parcel_id").alias("coverage"))
    return scenes.join(hits, "scene_id", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0)))


def assign_pixels(grid: DataFrame, parcels: DataFrame, block: float) -> DataFrame:
    """Parcel of each pixel whose centre (``x``, ``y``) lies in its ring.

    ``grid`` has one row per pixel position (``tile``, ``row_no``, ``col_no``, ``x``, ``y``),
    without dates. Pixels outside every parcel are left out. Where parcels overlap the one with
    the higher ``ord`` wins. Parcels are spread over blocks of side ``block``.
    """
    p = _on_grid(parcels, block).alias("p")
    g = grid.withColumn("_cx", F.floor(F.col("x") / block)).withColumn("_cy", F.floor(F.col("y") / block)).alias("g")
    inside = point_in_ring(F.col("g.x"), F.col("g.y"), F.col("p.ring"))
    hits = g.join(p, (F.col("p._cx") == F.col("g._cx")) & (F.col("p._cy") == F.col("g._cy"))).where(
        (F.col("g.x") >= F.col("p.minx"))
        & (F.col("g.x") <= F.col("p.maxx"))
        & (F.col("g.y") >= F.col("p.miny"))
        & (F.col("g.y") <= F.col("p.maxy"))
        & inside
    )
    # The block stays in the grouping keys: after a shuffle join no further exchange is needed.
    return (
        hits.groupBy("g._cx", "g._cy", "g.tile", "g.row_no", "g.col_no")
        .agg(F.max_by("p.parcel_id", "p.ord").alias("parcel_id"))
        .drop("_cx", "_cy")
    )
