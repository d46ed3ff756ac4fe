"""Queries over aggregation, series features, gap filling, reshaping and the time grid."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from furrow.checks import views as v
from furrow.checks.cleaning import NAMES, WIDE_SQL, cells40, dense
from furrow.checks.registry import check
from furrow.checks.views import r6, r6s
from furrow.functions import quality, text
from furrow.operators import aggregate, clean, gapfill, importance, joins, phenology, reshape, scaling, timegrid
from furrow.operators.quantiles import exact_quantiles

QUOTED = ", ".join(f'"{n}"' for n in NAMES)
CELL = "parcel_id, cast(date AS varchar) AS date, idx"


@check("a1_weighted_mean", "agg40", f"SELECT {CELL}, {r6('value', 'value')} FROM agg40")
def _(spark, sf):
    return cells40(spark, sf)


@check(
    "a1_weighted_mean_labelled",
    "agg40 parcel_labels",
    f"SELECT {CELL}, {r6('value', 'value')} FROM agg40 WHERE parcel_id IN (SELECT parcel_id FROM parcel_labels)",
)
def _(spark, sf):
    return clean.labelled_only(cells40(spark, sf), v.parcel_labels(spark, sf))


@check(
    "a2_bin_aggregate",
    "training",
    f"""WITH lo AS (SELECT min(date) AS d0 FROM training),
    b AS (SELECT * REPLACE (d0 + cast(floor((date - d0) / 5.0::DOUBLE) AS int) * 5 AS date) FROM training, lo)
    SELECT {CELL}, {r6('avg(value_mean)', 'value_mean')}, {r6('avg(cloud_scene)', 'cloud_scene')}, {r6('avg(px_count)', 'px_count')},
    min(tile) AS tile, min(label) AS label, min(label_group) AS label_group FROM b GROUP BY parcel_id, b.date, idx""",
)
def _(spark, sf):
    return aggregate.bin_aggregate(timegrid.bin_dates(v.training(spark, sf), "5D"))


@check("a3_quality_by_date", "binned", f"SELECT parcel_id, cast(date AS varchar) AS date, {r6('avg(cloud_scene)', 'cloud_scene')}, {r6('avg(px_count)', 'px_count')} FROM binned GROUP BY parcel_id, binned.date")
def _(spark, sf):
    return aggregate.quality_by_date(aggregate.bin_aggregate(v.training(spark, sf)))


@check("a7_class_counts", "labels_raw", "SELECT label, count(*) AS n FROM labels_raw GROUP BY 1 ORDER BY 2 DESC, 1")
def _(spark, sf):
    return aggregate.class_counts(v.labels_raw(spark, sf))


@check("a8_parcels_per_date", "agg40", "SELECT cast(date AS varchar) AS date, count(DISTINCT parcel_id) AS n_parcels FROM agg40 GROUP BY agg40.date")
def _(spark, sf):
    return aggregate.parcels_per_date(cells40(spark, sf))


@check(
    "a9_phenology_stats",
    "agg40",
    f"""SELECT parcel_id, idx, {r6('avg(value)', 'mean')}, {r6('stddev_samp(value)', 'std')}, {r6('min(value)', 'min')}, {r6('max(value)', 'max')},
    {r6('median(value)', 'median')}, {r6('max(value) - min(value)', 'amp')} FROM agg40 GROUP BY ALL""",
)
def _(spark, sf):
    return phenology.phenology_stats(cells40(spark, sf))


@check(
    "w1_peak_doy",
    "agg40",
    f"""SELECT parcel_id, idx, {r6('dayofyear(arg_max(date, struct_pack(v := value, d := -epoch(date))))', 'doy_peak')} FROM agg40 GROUP BY ALL""",
)
def _(spark, sf):
    return phenology.peak_doy(cells40(spark, sf))


@check(
    "w1_trough_doy",
    "agg40",
    f"""SELECT parcel_id, idx, {r6('dayofyear(arg_min(date, struct_pack(v := value, d := epoch(date))))', 'doy_trough')} FROM agg40 GROUP BY ALL""",
)
def _(spark, sf):
    return phenology.trough_doy(cells40(spark, sf))


@check(
    "w2_auc_trapezoid",
    "agg40",
    f"""SELECT parcel_id, idx, {r6('coalesce(sum(0.5 * (value + nv) * (nd - d)), 0)', 'auc')} FROM
    (SELECT parcel_id, idx, value, dayofyear(date) AS d, lead(value) OVER w AS nv, lead(dayofyear(date)) OVER w AS nd
     FROM agg40 WINDOW w AS (PARTITION BY parcel_id, idx ORDER BY date)) GROUP BY ALL""",
)
def _(spark, sf):
    return phenology.auc_trapezoid(cells40(spark, sf))


SUMMARY = ", ".join(
    f"""{r6(f'avg("{n}")', f'"{n}_mean"')}, {r6(f'max("{n}")', f'"{n}_max"')}, {r6(f'min("{n}")', f'"{n}_min"')},
    {r6(f'stddev_pop("{n}")', f'"{n}_std"')}, {r6(f'max("{n}") - min("{n}")', f'"{n}_amplitude"')},
    {r6(f'dayofyear(arg_max(date, struct_pack(v := "{n}", p := -pos)))', f'"{n}_peak_doy"')},
    {r6(f'arg_max(pos, struct_pack(v := "{n}", p := -pos)) / greatest(count(*) - 1, 1)', f'"{n}_peak_pos"')},
    {r6(f'coalesce(sum(0.5 * ("{n}" + "n{n}") * (nd - dayofyear(date))), 0)', f'"{n}_auc"')},
    {r6(f'(arg_max("{n}", pos) - arg_min("{n}", pos)) / greatest(count(*) - 1, 1)', f'"{n}_mean_diff"')}"""
    for n in NAMES
)

INTERLEAVED = f"""WITH dates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS dp FROM (SELECT DISTINCT date FROM agg40)),
    names AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {i})" for i, n in enumerate(NAMES))}) AS n(idx, ip)),
    grid AS (SELECT date, idx, dp * {len(NAMES)} + ip AS pos FROM dates CROSS JOIN names),
    dense AS (SELECT p.parcel_id, g.date, g.idx, g.pos, a.value FROM (SELECT DISTINCT parcel_id FROM agg40) p CROSS JOIN grid g
      LEFT JOIN agg40 a ON a.parcel_id = p.parcel_id AND a.date = g.date AND a.idx = g.idx),
    near AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0, last_value(value IGNORE NULLS) OVER b AS v0,
      first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS p1, first_value(value IGNORE NULLS) OVER f AS v1 FROM dense
      WINDOW b AS (PARTITION BY parcel_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      f AS (PARTITION BY parcel_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    filled AS (SELECT parcel_id, date, idx, CASE WHEN value IS NOT NULL THEN value WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL THEN v0
      ELSE v0 + (v1 - v0) / (p1 - p0) * (pos - p0) END AS value FROM near),
    wide AS (SELECT parcel_id, date, {WIDE_SQL} FROM filled GROUP BY ALL),
    valid AS (SELECT * FROM wide WHERE greatest({QUOTED}) <> least({QUOTED})),
    steps AS (SELECT *, row_number() OVER w - 1 AS pos, {', '.join(f'lead("{n}") OVER w AS "n{n}"' for n in NAMES)}, lead(dayofyear(date)) OVER w AS nd
      FROM valid WINDOW w AS (PARTITION BY parcel_id ORDER BY date))
    """


def interleaved(spark, sf):
    agg = cells40(spark, sf)
    return gapfill.interpolate_interleaved(agg, reshape.date_list(agg), NAMES)


@check("w7_interpolate_interleaved", "agg40", INTERLEAVED + f"SELECT {CELL}, {r6('value', 'value')} FROM filled")
def _(spark, sf):
    return interleaved(spark, sf)


def valid_steps(spark, sf):
    return phenology.drop_padding(reshape.pivot_index(interleaved(spark, sf), NAMES), NAMES)


@check("w8_drop_padding", "agg40", INTERLEAVED + f"SELECT parcel_id, cast(date AS varchar) AS date, {r6s(' '.join(NAMES))} FROM valid")
def _(spark, sf):
    return valid_steps(spark, sf)


@check("a10_temporal_summary", "agg40", INTERLEAVED + f"SELECT parcel_id, count(*) AS n_valid_dates, {SUMMARY} FROM steps GROUP BY 1")
def _(spark, sf):
    return phenology.temporal_summary(valid_steps(spark, sf), NAMES)


@check(
    "w3_w5_series_shape",
    "agg40",
    INTERLEAVED
    + "SELECT parcel_id, "
    + ", ".join(
        f"""{r6(f'coalesce(sum(0.5 * ("{n}" + "n{n}") * (nd - dayofyear(date))), 0)', f'"{n}_auc"')},
        {r6(f'arg_max(pos, struct_pack(v := "{n}", p := -pos)) / greatest(count(*) - 1, 1)', f'"{n}_peak_pos"')},
        {r6(f'(arg_max("{n}", pos) - arg_min("{n}", pos)) / greatest(count(*) - 1, 1)', f'"{n}_mean_diff"')}"""
        for n in NAMES
    )
    + " FROM steps GROUP BY 1",
)
def _(spark, sf):
    out = phenology.temporal_summary(valid_steps(spark, sf), NAMES)
    return out.select("parcel_id", *[f"{n}_{shape}" for n in NAMES for shape in ("auc", "peak_pos", "mean_diff")])


FILLED = """WITH slots AS (SELECT idx, date, row_number() OVER (PARTITION BY idx ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT idx, date FROM agg40)),
    dense AS (SELECT p.parcel_id, s.idx, s.date, s.pos, a.value FROM (SELECT DISTINCT parcel_id, idx FROM agg40) p JOIN slots s USING (idx)
      LEFT JOIN agg40 a ON a.parcel_id = p.parcel_id AND a.date = s.date AND a.idx = s.idx),
    near AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS p0, last_value(value IGNORE NULLS) OVER b AS v0,
      first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS p1, first_value(value IGNORE NULLS) OVER f AS v1 FROM dense
      WINDOW b AS (PARTITION BY parcel_id, idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      f AS (PARTITION BY parcel_id, idx ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    filled AS (SELECT parcel_id, date, idx, CASE WHEN value IS NOT NULL THEN value WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL THEN v0
      ELSE v0 + (v1 - v0) / (p1 - p0) * (pos - p0) END AS value FROM near)
    """


@check("w6_interpolate", "agg40", FILLED + f"SELECT {CELL}, {r6('value', 'value')} FROM filled")
def _(spark, sf):
    return gapfill.interpolate(cells40(spark, sf))


def sparse_cells(spark, sf):
    """Cells in which some parcels lack a whole index."""
    bare = (F.col("parcel_id").cast("int") % 4 == 0) & (F.col("idx") == "VIEW")
    return cells40(spark, sf).where(~bare)


@check(
    "a16_impute_median",
    "agg40",
    FILLED.replace("agg40", "thin").replace("WITH slots", "WITH thin AS (SELECT * FROM agg40 WHERE NOT (cast(parcel_id AS int) % 4 = 0 AND idx = 'VIEW')), slots")
    + f""", med AS (SELECT idx, date, median(value) AS value FROM filled GROUP BY ALL),
    gone AS (SELECT parcel_id, idx FROM (SELECT DISTINCT parcel_id FROM thin) CROSS JOIN (SELECT DISTINCT idx FROM thin)
      EXCEPT SELECT parcel_id, idx FROM thin)
    SELECT {CELL}, {r6('value', 'value')} FROM filled UNION ALL SELECT {CELL}, {r6('value', 'value')} FROM gone JOIN med USING (idx)""",
)
def _(spark, sf):
    return gapfill.impute_median(gapfill.interpolate(sparse_cells(spark, sf)))


@check(
    "a11_describe_exact",
    "obs",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", {r6(f'avg({c})', 'mean')}, {r6(f'stddev_samp({c})', 'std')}, {r6(f'min({c})', 'min')},
        {r6(f'quantile_cont({c}, 0.25)', 'q25')}, {r6(f'quantile_cont({c}, 0.5)', 'q50')}, {r6(f'quantile_cont({c}, 0.75)', 'q75')}, {r6(f'max({c})', 'max')} FROM obs"""
        for c in ("value_mean", "px_count", "cloud_scene")
    ),
)
def _(spark, sf):
    return aggregate.describe_exact(v.obs(spark, sf), ["value_mean", "px_count", "cloud_scene"])


@check(
    "a12_index_correlation",
    "agg40",
    f"WITH w AS (SELECT parcel_id, date, {WIDE_SQL} FROM agg40 GROUP BY ALL) "
    + " UNION ALL ".join(f"""SELECT '{a}' AS a, '{b}' AS b, {r6(f'corr("{a}", "{b}")', 'corr')} FROM w""" for a in NAMES for b in NAMES),
)
def _(spark, sf):
    return aggregate.index_correlation(reshape.pivot_index(cells40(spark, sf), NAMES), NAMES)


@check(
    "a13_missing_ratio",
    "agg40",
    f"""WITH s AS (SELECT count(DISTINCT (idx, date)) AS k, count(DISTINCT parcel_id) AS n, count(*) AS c FROM agg40)
    SELECT {r6('1 - c / (n * k)', 'missing_ratio')} FROM s""",
)
def _(spark, sf):
    wide = reshape.pivot_index_date(cells40(spark, sf))
    return aggregate.missing_ratio(wide, wide.columns[1:])


@check(
    "a13_missing_ratio_long",
    "agg40",
    f"SELECT {r6('1 - count(*) / (count(DISTINCT parcel_id) * 150)', 'missing_ratio')} FROM agg40",
)
def _(spark, sf):
    return aggregate.missing_ratio_long(cells40(spark, sf), 150)


SPLIT = "CASE WHEN cast(parcel_id AS int) % 5 = 0 THEN 'test' ELSE 'train' END"


def split_cells(spark, sf):
    part = F.when(F.col("parcel_id").cast("int") % 5 == 0, "test").otherwise("train")
    return dense(spark, sf).withColumn("split", part)


@check(
    "a14_fit_masked_scaler",
    "cells",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS feature, {r6(f'avg("{n}")', 'mean')}, {r6(f'greatest(stddev_pop("{n}"), 1e-6)', 'std')}, count("{n}") AS "count" FROM cells
        WHERE observed AND {SPLIT} = 'train'"""
        for n in NAMES
    ),
)
def _(spark, sf):
    return scaling.fit_masked_scaler(split_cells(spark, sf), NAMES)


@check(
    "f18_standardise",
    "cells",
    f"""WITH s AS (SELECT {', '.join(f'avg("{n}") AS "m{n}", stddev_pop("{n}") AS "d{n}"' for n in NAMES)} FROM cells WHERE observed AND {SPLIT} = 'train')
    SELECT parcel_id, t, {', '.join(r6(f'CASE WHEN observed THEN ("{n}" - "m{n}") / "d{n}" ELSE 0 END', f'"{n}"') for n in NAMES)} FROM cells, s""",
)
def _(spark, sf):
    rows = split_cells(spark, sf)
    return scaling.apply_scaler(rows, scaling.fit_masked_scaler(rows, NAMES)).select("parcel_id", "t", *NAMES)


@check(
    "a15_fit_global_scaler",
    "cells",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS feature, {r6(f'avg("{n}")', 'mean')}, {r6(f'stddev_pop("{n}") + 1e-6', 'std')}, count("{n}") AS "count" FROM cells""" for n in NAMES
    ),
)
def _(spark, sf):
    return scaling.fit_global_scaler(dense(spark, sf), NAMES)


@check("a23_mean_curve", "training", f"SELECT cast(date AS varchar) AS date, idx, {r6('avg(value_mean)', 'mean_value')} FROM training WHERE label = 'BUILDING' GROUP BY training.date, idx")
def _(spark, sf):
    return aggregate.mean_curve(clean.of_label(v.training(spark, sf), "BUILDING"))


@check("w9_window_start", "scenes", "SELECT scene_id, cast(date '1992-01-01' + cast(floor((date - date '1992-01-01') / 5.0::DOUBLE) AS int) * 5 AS varchar) AS win FROM scenes")
def _(spark, sf):
    start = F.lit(datetime.date(1992, 1, 1))
    return v.scenes(spark, sf).select("scene_id", timegrid.window_start(F.col("date"), start, 5).alias("win"))


@check(
    "w10_bin_dates",
    "obs",
    """WITH lo AS (SELECT min(date) AS d0 FROM obs) SELECT parcel_id, idx, cast(d0 + cast(floor((date - d0) / 7.0::DOUBLE) AS int) * 7 AS varchar) AS date FROM obs, lo""",
)
def _(spark, sf):
    return timegrid.bin_dates(v.obs(spark, sf), "7D").select("parcel_id", "idx", "date")


@check("w10_bin_dates_calendar", "obs", "SELECT parcel_id, idx, cast(cast(date_trunc('week', date) AS date) AS varchar) AS date FROM obs")
def _(spark, sf):
    return timegrid.bin_dates(v.obs(spark, sf), "W").select("parcel_id", "idx", "date")


@check("w11_time_grid", "obs", "SELECT row_number() OVER (ORDER BY d) - 1 AS t, cast(cast(d AS date) AS varchar) AS date FROM (SELECT unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 5 DAY)) AS d FROM obs)")
def _(spark, sf):
    return timegrid.time_grid(v.obs(spark, sf), "5D")


@check("w11_time_grid_dates", "grid", "SELECT t, cast(date AS varchar) AS date FROM grid")
def _(spark, sf):
    return timegrid.time_grid(v.obs(spark, sf))


@check(
    "w12_observed_mask",
    "agg40",
    """SELECT p.parcel_id, cast(d.date AS varchar) AS date, count(a.value) > 0 AS observed FROM (SELECT DISTINCT parcel_id FROM agg40) p
    CROSS JOIN (SELECT DISTINCT date FROM agg40) d LEFT JOIN agg40 a ON a.parcel_id = p.parcel_id AND a.date = d.date GROUP BY p.parcel_id, d.date""",
)
def _(spark, sf):
    agg = cells40(spark, sf)
    wide = joins.densify(reshape.pivot_index(agg, NAMES), reshape.date_list(agg))
    return wide.select("parcel_id", "date", timegrid.observed(NAMES).alias("observed"))


@check(
    "t1_limit_dates",
    "agg40",
    f"""SELECT {CELL}, {r6('value', 'value')} FROM agg40 WHERE agg40.date IN (SELECT date FROM agg40 GROUP BY 1 ORDER BY count(DISTINCT parcel_id) DESC, 1 LIMIT 12)""",
)
def _(spark, sf):
    return timegrid.limit_dates(cells40(spark, sf), 12)


@check("t5_top_classes", "obs labels_raw", "SELECT parcel_id AS label, count(*) AS n FROM labels_raw GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(spark, sf):
    return aggregate.top_classes(v.labels_raw(spark, sf), 20, "parcel_id").withColumnRenamed("parcel_id", "label")


@check("t6_canonical_order", "agg40", f"SELECT {CELL}, {r6('value', 'value')} FROM agg40")
def _(spark, sf):
    return reshape.canonical_order(cells40(spark, sf))


R1_DATES = [f"2024-01-{d:02d}" for d in range(1, 31)]


@check(
    "r1_pivot_index_date",
    "agg40",
    "SELECT parcel_id, "
    + ", ".join(r6(f"avg(value) FILTER (idx = '{i}' AND date = '{d}')", f'"{i}__{d}"') for i in NAMES for d in R1_DATES)
    + " FROM agg40 GROUP BY 1",
)
def _(spark, sf):
    return reshape.pivot_index_date(cells40(spark, sf))


@check(
    "r2_pivot_index",
    "obs",
    "SELECT parcel_id, cast(date AS varchar) AS date, " + ", ".join(r6(f"avg(value_mean) FILTER (idx = '{i}')", f'"{i}"') for i in NAMES) + " FROM obs GROUP BY parcel_id, obs.date",
)
def _(spark, sf):
    return reshape.pivot_index(v.obs(spark, sf), value="value_mean")


@check(
    "r3_pivot_date_index",
    "agg40",
    "SELECT parcel_id, "
    + ", ".join(r6(f"avg(value) FILTER (idx = '{i}' AND date = '{d}')", f'"{d}__{i}"') for d in R1_DATES for i in NAMES)
    + " FROM agg40 GROUP BY 1",
)
def _(spark, sf):
    return reshape.pivot_date_index(cells40(spark, sf), R1_DATES, NAMES)


STAT_SQL = {
    "mean": "avg(value)",
    "std": "stddev_samp(value)",
    "min": "min(value)",
    "max": "max(value)",
    "median": "median(value)",
    "amp": "max(value) - min(value)",
    "doy_peak": "dayofyear(arg_max(date, struct_pack(v := value, d := -epoch(date))))",
    "doy_trough": "dayofyear(arg_min(date, struct_pack(v := value, d := epoch(date))))",
    "auc": "coalesce(sum(0.5 * (value + nv) * (nd - dayofyear(date))), 0)",
}


@check(
    "r4_pivot_phenology",
    "agg40",
    f"""WITH s AS (SELECT parcel_id, idx, {', '.join(f'{e} AS "{n}"' for n, e in STAT_SQL.items())} FROM
    (SELECT *, lead(value) OVER w AS nv, lead(dayofyear(date)) OVER w AS nd FROM agg40 WINDOW w AS (PARTITION BY parcel_id, idx ORDER BY date)) GROUP BY ALL)
    SELECT parcel_id, {', '.join(r6(f'max("{s}") FILTER (idx = ' + f"'{i}')", f'"{i}__{s}"') for i in NAMES for s in STAT_SQL)} FROM s GROUP BY 1""",
)
def _(spark, sf):
    return reshape.pivot_phenology(phenology.phenology(cells40(spark, sf)))


@check(
    "r10_to_tensor",
    "cells",
    "SELECT parcel_id, t, dayofyear(date) AS doy, observed, "
    + ", ".join(r6(f'cast("{c}" AS float)', f'"{c}"') for c in ["cloud_scene", "px_count", *NAMES])
    + " FROM cells",
)
def _(spark, sf):
    return timegrid.from_tensor(tensor(spark, sf), NAMES)


def tensor(spark, sf):
    binned = aggregate.bin_aggregate(v.training(spark, sf))
    steps = binned.groupBy("parcel_id", "date").agg(*reshape.index_columns(NAMES, "value_mean"), *aggregate.quality_columns())
    return timegrid.to_tensor(steps, NAMES, reshape.date_list(binned))


@check("r11_from_tensor", "cells", "SELECT parcel_id, count(*) AS n_steps, count(*) FILTER (observed) AS n_observed FROM cells GROUP BY 1")
def _(spark, sf):
    rows = timegrid.from_tensor(tensor(spark, sf), NAMES)
    return rows.groupBy("parcel_id").agg(F.count(F.lit(1)).alias("n_steps"), F.count_if(F.col("observed")).alias("n_observed"))


@check("f12_doy", "obs", "SELECT parcel_id, idx, dayofyear(date) AS doy FROM obs")
def _(spark, sf):
    return v.obs(spark, sf).select("parcel_id", "idx", text.doy("date").alias("doy"))


@check("f13_doy_fourier", "obs", f"SELECT parcel_id, idx, {r6('sin(2 * pi() * least(greatest(dayofyear(date), 1), 366) / 366)', 'doy_sin')}, {r6('cos(2 * pi() * least(greatest(dayofyear(date), 1), 366) / 366)', 'doy_cos')} FROM obs")
def _(spark, sf):
    return v.obs(spark, sf).select("parcel_id", "idx", quality.doy_fourier(text.doy("date")).alias("q")).select("parcel_id", "idx", "q.*")


@check(
    "f14_f16_quality",
    "cells",
    f"""WITH q AS (SELECT parcel_id, t, observed, CASE WHEN observed THEN least(greatest(cloud_scene / 100, 0), 1) ELSE 1 END AS c,
    CASE WHEN observed THEN least(greatest(ln(1 + greatest(px_count, 0)) / ln(257), 0), 1) ELSE 0 END AS p FROM cells)
    SELECT parcel_id, t, {r6('CASE WHEN observed THEN (1 - c) * sqrt(p) ELSE 0 END', 'reliability')}, {r6('c', 'cloud_norm')}, {r6('p', 'px_norm')} FROM q""",
)
def _(spark, sf):
    q = quality.quality_struct(F.col("observed"), F.col("cloud_scene"), F.col("px_count"))
    return dense(spark, sf).select("parcel_id", "t", q.alias("q")).select("parcel_id", "t", "q.*")


@check(
    "f17_quality_inputs",
    "cells",
    f"""SELECT parcel_id, t, {r6('CASE WHEN observed THEN least(greatest(cloud_scene / 50, 0), 1) ELSE 0 END', 'q0')},
    {r6('CASE WHEN observed THEN least(greatest(px_count / 60, 0), 1) ELSE 1 END', 'q1')}, {r6('0', 'q2')}, {r6('observed::int', 'd0')}, {r6('1 - observed::int', 'd1')} FROM cells""",
)
def _(spark, sf):
    given = quality.quality_inputs(F.col("observed"), F.array(F.col("cloud_scene") / 50, F.col("px_count") / 60))
    rows = dense(spark, sf).select("parcel_id", "t", given.alias("q"), quality.quality_inputs(F.col("observed")).alias("d"))
    return rows.select("parcel_id", "t", *[F.get("q", F.lit(i)).alias(f"q{i}") for i in range(3)], *[F.get("d", F.lit(i)).alias(f"d{i}") for i in range(2)])


@check(
    "f19_feature_names",
    "obs",
    """SELECT concat(idx, '__', cast(date AS varchar)) AS feature, idx, cast(date AS varchar) AS suffix, count(*) AS n FROM obs GROUP BY ALL""",
)
def _(spark, sf):
    named = v.obs(spark, sf).select(text.feature_name("idx", "date").alias("feature"))
    return named.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).select("feature", text.split_feature("feature").alias("f"), "n").select("feature", "f.*", "n")


@check(
    "f32_masked_pool",
    "cells",
    f"""WITH q AS (SELECT *, observed::int * greatest(1 - cloud_scene / 100, 0.05::DOUBLE) AS w FROM cells)
    SELECT parcel_id, {', '.join(r6(f'sum("{n}" * w) / greatest(sum(w), 1)', f'"{n}"') for n in NAMES)} FROM q GROUP BY 1""",
)
def _(spark, sf):
    rows = dense(spark, sf).withColumn("r", 1.0 - F.col("cloud_scene") / 100.0)
    return timegrid.masked_pool(rows, NAMES, "r")


@check(
    "a20_importance_by_date",
    "obs",
    f"SELECT cast(date AS varchar) AS date, {r6('sum(value_mean)', 'gain')} FROM obs GROUP BY obs.date",
)
def _(spark, sf):
    gains = v.obs(spark, sf).select(text.feature_name("idx", "date").alias("feature"), F.col("value_mean").alias("gain"))
    extra = gains.select(F.regexp_replace("feature", "__.*", "__mean").alias("feature"), "gain")
    return importance.importance_by_date_and_index(gains.unionByName(extra))[0]


@check("a20_importance_by_index", "obs", f"SELECT idx, {r6('sum(value_mean)', 'gain')} FROM obs GROUP BY idx")
def _(spark, sf):
    gains = v.obs(spark, sf).select(text.feature_name("idx", "date").alias("feature"), F.col("value_mean").alias("gain"))
    return importance.importance_by_date_and_index(gains)[1]


@check(
    "a21_temporal_importance",
    "cells",
    f"""SELECT cast(date AS varchar) AS date, dayofyear(date) AS doy, {r6(f"sum(({' + '.join(QUOTED.split(', '))}) * observed::int) / greatest(sum(observed::int), 1e-6)", 'mean_score')} FROM cells GROUP BY cells.date""",
)
def _(spark, sf):
    return importance.temporal_importance(dense(spark, sf).withColumn("score", sum((F.col(n) for n in NAMES[1:]), F.col(NAMES[0]))))


@check("t3_top_features", "obs", f"SELECT * FROM (SELECT concat(idx, '__', cast(date AS varchar)) AS feature, {r6('avg(value_mean)', 'importance')} FROM obs GROUP BY 1) ORDER BY importance DESC, feature LIMIT 15")
def _(spark, sf):
    imp = v.obs(spark, sf).groupBy(text.feature_name("idx", "date").alias("feature")).agg(F.avg("value_mean").alias("importance"))
    return importance.top_features(imp, 15)


@check(
    "m5_named_features",
    "",
    """SELECT CASE c_custkey % 5 WHEN 0 THEN 'CLICK' WHEN 1 THEN 'ERROR' WHEN 2 THEN 'PURCHASE' ELSE c_mktsegment END AS feature, count(*) AS n
    FROM customer WHERE c_custkey % 5 <> 4 GROUP BY 1""",
)
def _(spark, sf):
    m = F.col("c_custkey") % 5
    raw = F.when(m < 3, F.concat(F.lit("f"), m.cast("string"))).when(m == 4, "f17").otherwise(F.col("c_mktsegment"))
    gains = v.table(spark, sf, "customer").select(raw.alias("feature"))
    return importance.named_features(gains, NAMES).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@check(
    "exact_quantiles_by_index",
    "agg40",
    " UNION ALL ".join(f"SELECT idx, {r6(str(p), 'prob')}, {r6(f'quantile_cont(value, {p})', 'quantile')} FROM agg40 GROUP BY idx" for p in (0.1, 0.25, 0.5, 0.9)),
)
def _(spark, sf):
    return exact_quantiles(cells40(spark, sf), ["idx"], "value", [0.1, 0.25, 0.5, 0.9])


@check(
    "j3_phenology",
    "agg40",
    f"""SELECT parcel_id, idx, {', '.join(r6(e, f'"{n}"') for n, e in STAT_SQL.items())} FROM
    (SELECT *, lead(value) OVER w AS nv, lead(dayofyear(date)) OVER w AS nd FROM agg40 WINDOW w AS (PARTITION BY parcel_id, idx ORDER BY date)) GROUP BY ALL""",
)
def _(spark, sf):
    return phenology.phenology(cells40(spark, sf))
