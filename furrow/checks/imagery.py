"""Queries over scenes, footprints, pixels and zonal statistics."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from furrow.checks import views as v
from furrow.checks.registry import check
from furrow.checks.views import r6
from furrow.config import INDEX_NAMES
from furrow.functions.spectral import all_indices, hidden
from furrow.operators import aggregate, raster, reshape, scenes, spatial
from furrow.plans.long_table import observe_parcels

INDEX_SQL = {
    "NDVI": "(nir - red) / (nir + red + 1e-6)",
    "NDMI": "(nir - swir) / (nir + swir + 1e-6)",
    "NDWI": "(green - nir) / (green + nir + 1e-6)",
    "EVI": "2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1 + 1e-6)",
    "GNDVI": "(nir - green) / (nir + green + 1e-6)",
    "SAVI": "1.5 * (nir - red) / (nir + red + 0.5 + 1e-6)",
    "OSAVI": "1.16 * (nir - red) / (nir + red + 0.16 + 1e-6)",
    "MSAVI": "0.5 * ((2 * nir + 1) - sqrt(greatest((2 * nir + 1) * (2 * nir + 1) - 8 * (nir - red), 0)))",
    "MNDWI": "(green - swir) / (green + swir + 1e-6)",
    "ARVI": "(nir - (2 * red - blue)) / (nir + (2 * red - blue) + 1e-6)",
    "BSI": "((swir + red) - (nir + blue)) / ((swir + red) + (nir + blue) + 1e-6)",
}
HIDDEN = "((nir = 0 AND red = 0) OR scl IN (0, 1, 3, 8, 9, 10, 11))"
PIXEL = "tile, cast(date AS varchar) AS date, parcel_id, row_no, col_no"

for _name, _sql in INDEX_SQL.items():

    @check(f"f_index_{_name.lower()}", "pixels", f"SELECT {PIXEL}, {r6(_sql, 'value')} FROM pixels")
    def _(spark, sf, name=_name):
        return v.pixels(spark, sf).select("tile", "date", "parcel_id", "row_no", "col_no", all_indices()[name].alias("value"))


@check("p15_mask_pixels", "pixels", f"SELECT {PIXEL}, {HIDDEN} AS hidden, " + ", ".join(r6(f"CASE WHEN {HIDDEN} THEN NULL ELSE {e} END", n.lower()) for n, e in INDEX_SQL.items()) + " FROM pixels")
def _(spark, sf):
    rows = raster.masked_indices(v.pixels(spark, sf), list(INDEX_SQL))
    return rows.select("tile", "date", "parcel_id", "row_no", "col_no", hidden().alias("hidden"), *[F.col(n).alias(n.lower()) for n in INDEX_SQL])


ZONAL = "WITH m AS (SELECT *, " + ", ".join(f'CASE WHEN {HIDDEN} THEN NULL ELSE {e} END AS "{n}"' for n, e in INDEX_SQL.items()) + " FROM pixels) "


@check(
    "a4_zonal_stats",
    "pixels",
    ZONAL
    + "SELECT tile, cast(date AS varchar) AS date, parcel_id, "
    + ", ".join(f'{r6(f"""avg("{n}")""", n.lower() + "_mean")}, count("{n}") AS {n.lower()}_count' for n in INDEX_SQL)
    + " FROM m GROUP BY tile, m.date, parcel_id",
)
def _(spark, sf):
    return raster.zonal_indices(v.pixels(spark, sf))


@check(
    "a4_zonal_stats_expected",
    "pixels",
    ZONAL
    + f"""SELECT e.tile, cast(e.date AS varchar) AS date, e.parcel_id, {', '.join(f"""{r6(f'z."a{n}"', n.lower() + '_mean')}, coalesce(z."c{n}", 0) AS {n.lower()}_count""" for n in INDEX_SQL)}
    FROM (SELECT DISTINCT tile, date, parcel_id + 1 AS parcel_id FROM pixels) e LEFT JOIN
    (SELECT tile, date, parcel_id, {', '.join(f'avg("{n}") AS "a{n}", count("{n}") AS "c{n}"' for n in INDEX_SQL)} FROM m GROUP BY ALL) z USING (tile, date, parcel_id)""",
)
def _(spark, sf):
    px = v.pixels(spark, sf)
    expected = px.select("tile", "date", (F.col("parcel_id") + 1).alias("parcel_id")).distinct()
    return raster.zonal_indices(px, expected=expected)


LONG = " UNION ALL ".join(
    f"""SELECT tile, date, parcel_id, cloud_scene, '{n}' AS idx, avg("{n}") AS value_mean, count("{n}") AS px_count, count("NDVI") AS ref FROM m JOIN picked USING (tile, date) GROUP BY ALL"""
    for n in INDEX_NAMES
)


@check(
    "r5_unpivot_zonal",
    "pixels",
    ZONAL
    + " UNION ALL ".join(
        f"""SELECT tile, cast(date AS varchar) AS date, parcel_id, '{n}' AS idx, {r6(f'avg("{n}")', 'value_mean')}, count("{n}") AS px_count FROM m GROUP BY tile, m.date, parcel_id"""
        for n in INDEX_SQL
    ),
)
def _(spark, sf):
    zones = raster.zonal_indices(v.pixels(spark, sf))
    return reshape.unpivot_zonal(zones, list(INDEX_SQL), ["tile", "date", "parcel_id"])


@check(
    "observe_parcels",
    "pixels scenes",
    ZONAL
    + f""", picked AS (SELECT tile, date, cloud AS cloud_scene FROM (SELECT *, row_number() OVER (PARTITION BY tile, cast(floor((date - date '1992-01-01') / 5.0::DOUBLE) AS int)
      ORDER BY coverage DESC, cloud, date, scene_id) AS rn FROM scenes WHERE coverage > 0 AND cloud < 80 AND date BETWEEN '1995-01-01' AND '1997-12-31') WHERE rn = 1),
    z AS ({LONG})
    SELECT tile, cast(date AS varchar) AS date, parcel_id, {r6('cloud_scene', 'cloud_scene')}, idx, {r6('value_mean', 'value_mean')}, px_count FROM z WHERE ref >= 1""",
)
def _(spark, sf):
    found = scenes.search_scenes(v.scenes(spark, sf), "1995-01-01", "1997-12-31")
    picked = scenes.select_scenes(found, "1992-01-01")
    return observe_parcels(v.pixels(spark, sf), picked, min_px_count=1)


@check(
    "j9_align_to_fine_grid",
    "pixels",
    f"""WITH coarse AS (SELECT tile, date, row_no // 2 AS r, col_no // 2 AS c, avg(swir) AS swir20 FROM pixels GROUP BY ALL)
    SELECT p.tile, cast(p.date AS varchar) AS date, parcel_id, row_no, col_no, {r6('swir20', 'swir20')} FROM pixels p
    JOIN coarse k ON k.tile = p.tile AND k.date = p.date AND k.r = row_no // 2 AND k.c = col_no // 2""",
)
def _(spark, sf):
    px = v.pixels(spark, sf)
    half = [F.floor(F.col(c) / 2).alias(c) for c in ("row_no", "col_no")]
    coarse = px.groupBy("tile", "date", *half).agg(F.avg("swir").alias("swir20"))
    fine = px.select("tile", "date", "parcel_id", "row_no", "col_no")
    return raster.align_to_fine_grid(coarse, fine)


@check("p13_search_scenes", "scenes", "SELECT scene_id, tile FROM scenes WHERE date BETWEEN '1995-01-01' AND '1996-12-31' AND cloud < 80 AND tile <> ''")
def _(spark, sf):
    return scenes.search_scenes(v.scenes(spark, sf), "1995-01-01", "1996-12-31").select("scene_id", "tile")


@check("p13_search_scenes_box", "scene_boxes", "SELECT scene_id FROM scene_boxes WHERE minx <= 4.5 AND maxx >= 2.6 AND miny <= 3 AND maxy >= 1 AND scene_id * 4 < 80")
def _(spark, sf):
    rows = v.scene_boxes(spark, sf).withColumns(
        {"date": F.lit(datetime.date(2024, 3, 1)), "cloud": F.col("scene_id") * 4.0, "tile": F.lit("T1")}
    )
    return scenes.search_scenes(rows, "2024-01-01", "2024-12-31", (2.6, 1.0, 4.5, 3.0)).select("scene_id")


@check("p14_require_assets", "", "SELECT l_orderkey AS scene_id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) FILTER (l_linenumber <= 4) = 4")
def _(spark, sf):
    lines = v.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("band")).distinct()
    found = lines.groupBy(F.col("l_orderkey").alias("scene_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("band", F.lit("href")))).alias("assets")
    )
    return scenes.require_assets(found, ["1", "2", "3", "4"]).select("scene_id")


@check(
    "w13_select_scenes",
    "scenes",
    """SELECT scene_id, tile, cast(date AS varchar) AS date, cast(win AS varchar) AS win, coverage, rank FROM (SELECT *, row_number() OVER (PARTITION BY tile, win ORDER BY coverage DESC, cloud, date, scene_id) AS rank
    FROM (SELECT *, date '1992-01-01' + cast(floor((date - date '1992-01-01') / 5.0::DOUBLE) AS int) * 5 AS win FROM scenes WHERE coverage > 0)) WHERE rank <= 2""",
)
def _(spark, sf):
    return scenes.select_scenes(v.scenes(spark, sf), "1992-01-01", 2).select("scene_id", "tile", "date", "win", "coverage", "rank")


@check("r12_scene_keys", "scenes", "SELECT tile, cast(date '1992-01-01' + cast(floor((date - date '1992-01-01') / 5.0::DOUBLE) AS int) * 5 AS varchar) AS win, count(*) AS n FROM scenes GROUP BY 1, 2")
def _(spark, sf):
    return scenes.scene_keys(v.scenes(spark, sf), "1992-01-01").groupBy("tile", "win").agg(F.count(F.lit(1)).alias("n"))


@check("t2_order_scenes", "scenes", "SELECT scene_id, tile FROM scenes ORDER BY tile, date, scene_id")
def _(spark, sf):
    return scenes.order_scenes(v.scenes(spark, sf)).select("scene_id", "tile")


@check("a17_total_bounds", "parcel_boxes", f"SELECT {r6('min(minx)', 'minx')}, {r6('min(miny)', 'miny')}, {r6('max(maxx)', 'maxx')}, {r6('max(maxy)', 'maxy')} FROM parcel_boxes")
def _(spark, sf):
    return aggregate.total_bounds(v.parcel_boxes(spark, sf))


OVERLAP = "p.minx <= s.maxx AND p.maxx >= s.minx AND p.miny <= s.maxy AND p.maxy >= s.miny"


@check("j7_parcels_in_footprint", "parcel_boxes scene_boxes", f"SELECT scene_id, parcel_id FROM parcel_boxes p JOIN scene_boxes s ON {OVERLAP}")
def _(spark, sf):
    return spatial.parcels_in_footprint(v.parcel_boxes(spark, sf), v.scene_boxes(spark, sf), 1.0).select("scene_id", "parcel_id")


def diamonds(spark, sf, half=0.45):
    """Parcels as diamonds around the centres of the boxes."""

    def at(dx, dy):
        return F.struct((F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y"))

    boxes = v.parcel_boxes(spark, sf).select("parcel_id", (F.col("minx") + 0.4).alias("cx"), (F.col("miny") + 0.4).alias("cy"))
    ring = F.array(at(half, 0.0), at(0.0, half), at(-half, 0.0), at(0.0, -half), at(half, 0.0))
    return spatial.with_box(boxes.select("parcel_id", ring.alias("ring"))).withColumn("ord", F.col("parcel_id"))


def footprints(spark, sf):
    def at(x, y):
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))

    ring = F.array(at("minx", "miny"), at("maxx", "miny"), at("maxx", "maxy"), at("minx", "maxy"))
    boxes = v.scene_boxes(spark, sf).withColumns({"maxx": F.col("maxx") - 0.4, "maxy": F.col("maxy") - 0.4})
    return boxes.withColumn("footprint", ring)


DIAMOND = """SELECT scene_id, parcel_id, p.minx + 0.4::DOUBLE AS cx, p.miny + 0.4::DOUBLE AS cy FROM parcel_boxes p JOIN scene_boxes s ON
    greatest(s.minx - (p.minx + 0.4), 0, p.minx + 0.4 - (s.maxx - 0.4)) + greatest(s.miny - (p.miny + 0.4), 0, p.miny + 0.4 - (s.maxy - 0.4)) <= 0.45::DOUBLE"""


@check("j7_parcels_in_footprint_polygons", "parcel_boxes scene_boxes", f"SELECT scene_id, parcel_id FROM ({DIAMOND})")
def _(spark, sf):
    return spatial.parcels_in_footprint(diamonds(spark, sf), footprints(spark, sf), 1.0, exact=True).select("scene_id", "parcel_id")


@check(
    "j7_crop_boxes",
    "parcel_boxes scene_boxes",
    f"""SELECT scene_id, {r6('min(cx) - 0.55', 'minx')}, {r6('min(cy) - 0.55', 'miny')}, {r6('max(cx) + 0.55', 'maxx')}, {r6('max(cy) + 0.55', 'maxy')}, count(*) AS n_parcels
    FROM ({DIAMOND}) GROUP BY 1""",
)
def _(spark, sf):
    return spatial.crop_boxes(spatial.parcels_in_footprint(diamonds(spark, sf), footprints(spark, sf), 1.0, exact=True), 0.1)


@check(
    "a5_scene_coverage",
    "parcel_boxes scene_boxes",
    f"SELECT scene_id, count(parcel_id) AS coverage FROM scene_boxes s LEFT JOIN parcel_boxes p ON {OVERLAP} GROUP BY 1",
)
def _(spark, sf):
    return spatial.scene_coverage(v.scene_boxes(spark, sf), v.parcel_boxes(spark, sf), 1.0).select("scene_id", "coverage")


@check(
    "j8_assign_pixels",
    "parcel_boxes",
    """WITH g AS (SELECT DISTINCT 'T0' AS tile, o_custkey % 1000 AS row_no, o_orderkey % 97 AS col_no FROM orders),
    c AS (SELECT *, row_no * 0.01013::DOUBLE + 0.0031::DOUBLE AS x, col_no * 0.1007::DOUBLE + 0.0071::DOUBLE AS y FROM g)
    SELECT tile, row_no, col_no, max(parcel_id) AS parcel_id FROM c JOIN parcel_boxes p
    ON abs(x - (p.minx + 0.4)) + abs(y - (p.miny + 0.4)) < 0.7::DOUBLE GROUP BY ALL""",
)
def _(spark, sf):
    o = v.table(spark, sf, "orders")
    grid = o.select(F.lit("T0").alias("tile"), (F.col("o_custkey") % 1000).alias("row_no"), (F.col("o_orderkey") % 97).alias("col_no")).distinct()
    grid = grid.withColumns({"x": F.col("row_no") * 0.01013 + 0.0031, "y": F.col("col_no") * 0.1007 + 0.0071})
    return spatial.assign_pixels(grid, diamonds(spark, sf, 0.7), 1.0)
