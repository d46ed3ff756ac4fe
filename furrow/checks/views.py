"""The engine's tables derived from the given star-schema tables, in Spark and in SQL.

Each view exists twice: a Spark function and the SQL text of the same rows, which the oracles
prepend as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def obs(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("parcel_id"),
        F.col("ts").cast("date").alias("date"),
        F.upper("event_type").alias("idx"),
        F.col("value").alias("value_mean"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("px_count"),
        ((F.col("event_id") * 37) % 101).cast("double").alias("cloud_scene"),
        F.concat(F.lit("T"), (F.col("user_id") % 7).cast("string")).alias("tile"),
    )


def parcel_labels(spark, sf):
    seg = F.col("c_mktsegment")
    group = F.when(seg.isin("MACHINERY", "AUTOMOBILE"), "G1").when(seg == "BUILDING", "").otherwise("G2")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("parcel_id"), seg.alias("label"), group.alias("label_group")
    )


def labels_raw(spark, sf):
    return table(spark, sf, "orders").select(
        F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit(".0")).alias("parcel_id"),
        F.col("o_orderpriority").alias("label"),
        F.col("o_orderkey").alias("input_seq"),
    )


def preds(spark, sf):
    v, y = F.col("vec_id"), F.col("label")
    return table(spark, sf, "embeddings").select(
        v.alias("id"),
        y.alias("y_true"),
        F.when(v % 3 == 0, (y + 1 + v % 2) % 9).otherwise(y).alias("y_pred"),
        F.when(v % 10 < 7, "train").when(v % 10 == 7, "val").otherwise("test").alias("split"),
    )


def pixels(spark, sf):
    dark = F.col("l_orderkey") % 17 == 0
    price, quantity = F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("T"), (F.col("l_suppkey") % 3).cast("string")).alias("tile"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_suppkey").alias("parcel_id"),
        (F.col("l_orderkey") % 100).alias("row_no"),
        F.col("l_linenumber").alias("col_no"),
        F.when(dark, F.lit(0.0)).otherwise(price).alias("nir"),
        F.when(dark, F.lit(0.0)).otherwise(quantity * 100).alias("red"),
        F.col("l_partkey").cast("double").alias("green"),
        (quantity * 50).alias("blue"),
        (price / 2).alias("swir"),
        F.col("l_linenumber").alias("scl"),
    )


def scenes(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("coverage"))
    return (
        table(spark, sf, "orders")
        .join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .select(
            F.col("o_orderkey").alias("scene_id"),
            F.concat(F.lit("T"), (F.col("o_custkey") % 7).cast("string")).alias("tile"),
            F.col("o_orderdate").cast("date").alias("date"),
            (F.floor(F.col("o_totalprice")) % 101).cast("double").alias("cloud"),
            F.coalesce("coverage", F.lit(0)).alias("coverage"),
        )
    )


def parcel_boxes(spark, sf):
    k = F.col("s_suppkey")
    x, y = (k % 10).cast("double"), F.floor(k / 10.0).cast("double")
    return table(spark, sf, "supplier").select(
        k.alias("parcel_id"), x.alias("minx"), y.alias("miny"), (x + 0.8).alias("maxx"), (y + 0.8).alias("maxy")
    )


def scene_boxes(spark, sf):
    k = F.col("n_nationkey")
    x, y = (k % 5) * 2.0, F.floor(k / 5.0) * 2.0
    return table(spark, sf, "nation").select(
        k.alias("scene_id"), x.alias("minx"), y.alias("miny"), (x + 2.5).alias("maxx"), (y + 2.5).alias("maxy")
    )


def logits(spark, sf):
    """Class scores of three models over all embedding values: score k of model m is the sum of the values at positions p with (p + m) % 10 = k."""
    vec = F.transform("embedding", lambda v: v.cast("double"))
    models = F.explode(F.sequence(F.lit(0), F.lit(2)))

    def score(k):
        return F.aggregate(F.filter("e", lambda v, p: (p + F.col("m")) % 10 == k), F.lit(0.0), lambda total, v: total + v)

    return (
        table(spark, sf, "embeddings")
        .select(F.col("vec_id").alias("id"), F.col("label").alias("y"), vec.alias("e"), models.alias("m"))
        .select("id", "y", F.concat(F.lit("m"), F.col("m").cast("string")).alias("model"), F.array(*[score(k) for k in range(10)]).alias("logits"))
    )


def training(spark, sf):
    labels = parcel_labels(spark, sf)
    return obs(spark, sf).join(labels, "parcel_id")


VIEWS = {
    "obs": r"""SELECT cast(user_id AS varchar) AS parcel_id, cast(ts AS date) AS date, upper(event_type) AS idx,
  value AS value_mean, cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS px_count,
  cast((event_id * 37) % 101 AS double) AS cloud_scene, concat('T', cast(user_id % 7 AS varchar)) AS tile FROM events""",
    "parcel_labels": r"""SELECT cast(c_custkey AS varchar) AS parcel_id, c_mktsegment AS label,
  CASE WHEN c_mktsegment IN ('MACHINERY','AUTOMOBILE') THEN 'G1' WHEN c_mktsegment = 'BUILDING' THEN '' ELSE 'G2' END AS label_group
  FROM customer""",
    "labels_raw": r"""SELECT concat(' ', cast(o_custkey AS varchar), '.0') AS parcel_id, o_orderpriority AS label, o_orderkey AS input_seq FROM orders""",
    "preds": r"""SELECT vec_id AS id, label AS y_true, CASE WHEN vec_id % 3 = 0 THEN (label + 1 + vec_id % 2) % 9 ELSE label END AS y_pred,
  CASE WHEN vec_id % 10 < 7 THEN 'train' WHEN vec_id % 10 = 7 THEN 'val' ELSE 'test' END AS split FROM embeddings""",
    "pixels": r"""SELECT concat('T', cast(l_suppkey % 3 AS varchar)) AS tile, cast(l_shipdate AS date) AS date, l_suppkey AS parcel_id,
  l_orderkey % 100 AS row_no, l_linenumber AS col_no,
  CASE WHEN l_orderkey % 17 = 0 THEN 0.0::DOUBLE ELSE l_extendedprice::DOUBLE END AS nir,
  CASE WHEN l_orderkey % 17 = 0 THEN 0.0::DOUBLE ELSE l_quantity::DOUBLE * 100 END AS red,
  l_partkey::DOUBLE AS green, l_quantity::DOUBLE * 50 AS blue, l_extendedprice::DOUBLE / 2 AS swir, l_linenumber AS scl FROM lineitem""",
    "scenes": r"""SELECT o_orderkey AS scene_id, concat('T', cast(o_custkey % 7 AS varchar)) AS tile, cast(o_orderdate AS date) AS date,
  cast(cast(floor(o_totalprice) AS bigint) % 101 AS double) AS cloud, count(l_orderkey) AS coverage
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate, o_totalprice""",
    "parcel_boxes": r"""SELECT s_suppkey AS parcel_id, cast(s_suppkey % 10 AS double) AS minx, cast(floor(s_suppkey / 10.0) AS double) AS miny,
  cast(s_suppkey % 10 AS double) + 0.8::DOUBLE AS maxx, cast(floor(s_suppkey / 10.0) AS double) + 0.8::DOUBLE AS maxy FROM supplier""",
    "scene_boxes": r"""SELECT n_nationkey AS scene_id, (n_nationkey % 5) * 2.0::DOUBLE AS minx, cast(floor(n_nationkey / 5.0) AS double) * 2.0::DOUBLE AS miny,
  (n_nationkey % 5) * 2.0::DOUBLE + 2.5::DOUBLE AS maxx, cast(floor(n_nationkey / 5.0) AS double) * 2.0::DOUBLE + 2.5::DOUBLE AS maxy FROM nation""",
    "logit_cells": r"""SELECT id, y, m, (p + m) % 10 AS k, sum(v ORDER BY p) AS x
  FROM (SELECT vec_id AS id, label AS y, unnest(range(0, len(embedding))) AS p, unnest(embedding)::DOUBLE AS v FROM embeddings), (SELECT unnest(range(0, 3)) AS m)
  GROUP BY ALL""",
    "training": r"""SELECT o.*, l.label, l.label_group FROM obs o JOIN parcel_labels l USING (parcel_id)""",
    # Weighted cells of the tabular filters, and of all rows.
    "agg40": r"""SELECT parcel_id, date, idx, sum(value_mean * px_count) / sum(px_count) AS value FROM obs
  WHERE cloud_scene <= 40 AND px_count >= 10 GROUP BY ALL""",
    "agg": r"""SELECT parcel_id, date, idx, sum(value_mean * px_count) / nullif(sum(px_count), 0) AS value FROM obs GROUP BY ALL""",
    "binned": r"""SELECT parcel_id, date, idx, avg(value_mean) AS value_mean, avg(cloud_scene) AS cloud_scene, avg(px_count) AS px_count,
  min(tile) AS tile, min(label) AS label, min(label_group) AS label_group FROM training GROUP BY ALL""",
    "grid": r"""SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM obs)""",
    "steps": r"""SELECT parcel_id, date, avg(value_mean) FILTER (idx = 'CLICK') AS "CLICK", avg(value_mean) FILTER (idx = 'PURCHASE') AS "PURCHASE",
  avg(value_mean) FILTER (idx = 'ERROR') AS "ERROR", avg(value_mean) FILTER (idx = 'SIGNUP') AS "SIGNUP", avg(value_mean) FILTER (idx = 'VIEW') AS "VIEW",
  avg(cloud_scene) AS cloud_scene, avg(px_count) AS px_count FROM binned GROUP BY ALL""",
    # The dense training cells: one row per labelled parcel with rows and per grid date.
    "cells": r"""SELECT p.parcel_id, g.t, g.date, s.date IS NOT NULL AS observed,
  coalesce(s."CLICK", 0) AS "CLICK", coalesce(s."PURCHASE", 0) AS "PURCHASE", coalesce(s."ERROR", 0) AS "ERROR",
  coalesce(s."SIGNUP", 0) AS "SIGNUP", coalesce(s."VIEW", 0) AS "VIEW",
  least(greatest(coalesce(s.cloud_scene, 100), 0), 100) AS cloud_scene, greatest(coalesce(s.px_count, 0), 0) AS px_count
  FROM (SELECT DISTINCT parcel_id FROM steps) p CROSS JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM steps)) g
  LEFT JOIN steps s ON s.parcel_id = p.parcel_id AND s.date = g.date""",
}

DEPENDS = {
    "training": ["obs", "parcel_labels"],
    "agg40": ["obs"],
    "agg": ["obs"],
    "binned": ["training"],
    "grid": ["obs"],
    "steps": ["binned"],
    "cells": ["steps"],
}


def with_views(names: str, body: str) -> str:
    """``WITH`` the named views (and what they build on) ``body``."""
    order: list[str] = []

    def add(name: str) -> None:
        for base in DEPENDS.get(name, []):
            add(base)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    if body.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body.lstrip()[len('WITH RECURSIVE'):]}"
    if body.lstrip().upper().startswith("WITH"):
        return f"WITH {ctes},\n{body.lstrip()[4:]}"
    return f"WITH {ctes}\n{body}"


def shown(df: DataFrame) -> DataFrame:
    """Doubles at six digits (no negative zero) and dates as text, for a comparison by value."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            # The small shift keeps exact ties from depending on the order of a sum.
            c = F.round(c.cast("double") + F.lit(1e-9), 6) + F.lit(0.0)
        elif kind in ("date", "timestamp"):
            c = c.cast("string")
        cols.append(c.alias(name))
    return df.select(*cols)


def r6(expr: str, name: str) -> str:
    """The same rounding in SQL."""
    return f"(round(cast({expr} AS double) + 1e-9::DOUBLE, 6) + 0.0::DOUBLE) AS {name}"


def r6s(names: str) -> str:
    return ", ".join(r6(f'"{n}"', f'"{n}"') for n in names.split())
