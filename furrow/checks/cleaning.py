"""Queries over scans, cleaning, filters, joins and label dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.checks import views as v
from furrow.checks.registry import check
from furrow.checks.views import r6
from furrow.functions import text
from furrow.operators import aggregate, clean, encode, joins, phenology, reshape
from furrow.plans.long_table import build_training
from furrow.schemas import OBSERVATIONS
from furrow.session import cut_lineage, scratch_path
from furrow.sources.readers import read_labels, read_observations, read_training
from furrow.sources.writers import dataset_summary, ingest_summary
from furrow.operators.splits import stratified_split
from furrow.operators.timegrid import to_tensor

OBS = f"cast(date AS varchar) AS date, tile, parcel_id, idx, {r6('value_mean', 'value_mean')}, px_count, {r6('cloud_scene', 'cloud_scene')}"
NAMES = ["CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW"]
#: The mean value of each index as a column.
WIDE_SQL = ", ".join(f"""avg(value) FILTER (idx = '{n}') AS "{n}\"""" for n in NAMES)


def as_csv(spark, rows):
    """The rows as a CSV file with a header; spaces around values stay."""
    path = scratch_path(spark)
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@check("s1_read_observations", "obs", f"SELECT {OBS} FROM obs")
def _(spark, sf):
    return read_observations(spark, as_csv(spark, v.obs(spark, sf)))


@check(
    "s2_read_labels",
    "labels_raw",
    "SELECT trim(parcel_id) AS parcel_id, arg_min(label, input_seq) AS label FROM labels_raw WHERE label IS NOT NULL GROUP BY 1",
)
def _(spark, sf):
    rows = read_labels(spark, as_csv(spark, v.labels_raw(spark, sf).orderBy("input_seq")))
    return aggregate.first_label(rows.withColumn("parcel_id", text.strip("parcel_id")))


@check(
    "s3_read_training",
    "training",
    f"""SELECT {OBS}, label, nullif(label_group, '') AS label_group FROM training
    WHERE idx IN ('CLICK', 'VIEW') AND px_count >= 10 AND cloud_scene <= 60""",
)
def _(spark, sf):
    rows = read_training(spark, as_csv(spark, v.training(spark, sf)), ["click", " view "], 10, 60.0)
    return rows.select(*[f.name for f in OBSERVATIONS.fields], "label", "label_group")


@check(
    "s9_ingest_summary",
    "training",
    """SELECT count(*) AS rows_written, count(DISTINCT parcel_id) AS n_parcels, count(DISTINCT label) AS n_labels,
    count(DISTINCT nullif(label_group, '')) AS n_groups, (SELECT count(*) FROM obs) AS rows_read FROM training WHERE cloud_scene <= 40""",
)
def _(spark, sf):
    rows = v.obs(spark, sf)
    return ingest_summary(rows, build_training(rows, v.parcel_labels(spark, sf), max_cloud_scene=40.0))


@check(
    "s10_profile",
    "obs",
    """SELECT count(*) AS n_rows, 7 AS n_columns, cast(min(date) AS varchar) AS min_date, cast(max(date) AS varchar) AS max_date,
    count(DISTINCT parcel_id) AS n_parcels FROM obs""",
)
def _(spark, sf):
    return aggregate.profile(v.obs(spark, sf))


@check(
    "s11_dataset_summary",
    "training",
    """WITH p AS (SELECT parcel_id, any_value(label) AS label, any_value(label_group) AS g FROM training GROUP BY 1),
    n AS (SELECT count(*) AS n FROM p)
    SELECT (SELECT n FROM n) AS n_parcels, (SELECT count(DISTINCT date) FROM training) AS n_steps, (SELECT count(DISTINCT idx) FROM training) AS n_features,
    (SELECT count(DISTINCT label) FROM p) AS n_classes, (SELECT count(DISTINCT nullif(g, '')) FROM p) AS n_groups,
    (SELECT n - ceil(n * 0.2::DOUBLE) FROM n)::BIGINT AS n_train, 0 AS n_val, (SELECT ceil(n * 0.2::DOUBLE) FROM n)::BIGINT AS n_test""",
)
def _(spark, sf):
    rows = v.training(spark, sf)
    binned = aggregate.bin_aggregate(rows)
    steps = binned.groupBy("parcel_id", "date").agg(*reshape.index_columns(NAMES, "value_mean"), *aggregate.quality_columns())
    ids = cut_lineage(encode.encode_labels(encode.encode_labels(aggregate.parcel_texts(binned)), "label_group", "group_id"))
    arrays = to_tensor(steps, NAMES, reshape.date_list(rows))
    return dataset_summary(arrays.join(stratified_split(ids), "parcel_id"))


@check(
    "p1_normalize_id",
    "labels_raw",
    r"SELECT input_seq, regexp_replace(trim(parcel_id), '\.0+$', '') AS parcel_id FROM labels_raw",
)
def _(spark, sf):
    return v.labels_raw(spark, sf).select("input_seq", text.normalize_id("parcel_id").alias("parcel_id"))


@check(
    "p2_normalize_text",
    "",
    "SELECT event_id, upper(trim(concat(' ', event_type, ' '))) AS idx, trim(concat('  ', event_type)) AS raw FROM events",
)
def _(spark, sf):
    rows = v.table(spark, sf, "events").select(
        "event_id", F.concat(F.lit(" "), "event_type", F.lit(" ")).alias("idx"), F.concat(F.lit("  "), "event_type").alias("raw")
    )
    return clean.normalize_columns(rows, texts=["raw"], uppers=["idx"])


@check("p3_drop_blank", "parcel_labels", "SELECT * FROM parcel_labels WHERE trim(label_group) <> ''")
def _(spark, sf):
    return clean.drop_blank(v.parcel_labels(spark, sf), ["label_group", "label"])


@check(
    "p4_parse_date",
    "",
    """SELECT l_orderkey, l_linenumber, cast(CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE cast(l_shipdate AS date) END AS varchar) AS date FROM lineitem""",
)
def _(spark, sf):
    raw = F.when(F.col("l_orderkey") % 5 == 0, "soon").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    rows = v.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("date"))
    return clean.coerce(clean.require_dates(clean.coerce(rows, dates=["date"])), dates=["date"])


@check(
    "p5_to_number",
    "",
    f"""SELECT o_orderkey, {r6("CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END", "value")} FROM orders""",
)
def _(spark, sf):
    raw = F.when(F.col("o_orderkey") % 8 == 0, "n/a").when(F.col("o_orderkey") % 4 == 0, "NaN").otherwise(F.col("o_totalprice").cast("string"))
    return clean.coerce(v.table(spark, sf, "orders").select("o_orderkey", raw.alias("value")), numbers=["value"])


@check(
    "p6_drop_missing",
    "",
    "SELECT event_id FROM events WHERE event_id % 3 <> 0 AND event_id % 7 <> 0",
)
def _(spark, sf):
    e = F.col("event_id")
    rows = v.table(spark, sf, "events").select("event_id", F.when(e % 3 != 0, e).alias("a"), F.when(e % 7 != 0, e).alias("b"), F.when(e % 2 != 0, e).alias("c"))
    return clean.drop_missing(rows, ["a", "b"]).select("event_id")


@check("p7_keep_indices", "obs", f"SELECT {OBS} FROM obs WHERE idx IN ('CLICK', 'VIEW')")
def _(spark, sf):
    return clean.keep_indices(v.obs(spark, sf), ["CLICK", "VIEW"])


@check(
    "p7_absent_indices",
    "obs",
    "SELECT w AS idx FROM (SELECT unnest(['CLICK', 'EVI', 'NDVI']) AS w) WHERE w NOT IN (SELECT idx FROM obs)",
)
def _(spark, sf):
    return clean.absent_indices(v.obs(spark, sf), ["NDVI", "CLICK", "EVI"])


@check("p8_max_cloud", "obs", f"SELECT {OBS} FROM obs WHERE cloud_scene <= 40 AND cloud_scene <> 7")
def _(spark, sf):
    rows = v.obs(spark, sf).withColumn("cloud_scene", F.when(F.col("cloud_scene") != 7, F.col("cloud_scene")))
    return clean.max_cloud(rows, 40.0)


@check("p9_min_px", "obs", f"SELECT {OBS} FROM obs WHERE coalesce(nullif(px_count, 30), 0) >= 10")
def _(spark, sf):
    rows = v.obs(spark, sf).withColumn("px_count", F.when(F.col("px_count") != 30, F.col("px_count")))
    return clean.min_px(clean.min_px(rows, 0), 10)


@check("p10_labelled_only", "obs parcel_labels", f"SELECT {OBS} FROM obs WHERE parcel_id IN (SELECT parcel_id FROM parcel_labels WHERE label <> 'BUILDING')")
def _(spark, sf):
    return clean.labelled_only(v.obs(spark, sf), v.parcel_labels(spark, sf).where("label <> 'BUILDING'"))


@check(
    "p11_min_class_count",
    "training",
    """SELECT parcel_id, label FROM (SELECT parcel_id, label, count(*) OVER (PARTITION BY label) AS n FROM (SELECT DISTINCT parcel_id, label FROM training))
    WHERE n >= 30""",
)
def _(spark, sf):
    return clean.min_class_count(v.training(spark, sf).select("parcel_id", "label").distinct(), 30)


@check(
    "p11_min_class_count_before_join",
    "obs parcel_labels",
    f"""SELECT {OBS}, label, label_group FROM obs JOIN parcel_labels USING (parcel_id)
    WHERE label IN (SELECT label FROM parcel_labels GROUP BY 1 HAVING count(*) >= 290) AND px_count >= 5 AND idx IN ('VIEW', 'ERROR')""",
)
def _(spark, sf):
    return build_training(v.obs(spark, sf), v.parcel_labels(spark, sf), ["VIEW", "ERROR"], None, 5, 290)


@check(
    "p12_min_obs",
    "cells",
    "SELECT parcel_id, t, observed FROM cells WHERE parcel_id IN (SELECT parcel_id FROM cells GROUP BY 1 HAVING count(*) FILTER (observed) >= 26)",
)
def _(spark, sf):
    return clean.min_obs(dense(spark, sf), 26).select("parcel_id", "t", "observed")


def dense(spark, sf):
    """Dense training cells: one row per parcel and date of the grid."""
    binned = aggregate.bin_aggregate(v.training(spark, sf))
    steps = binned.groupBy("parcel_id", "date").agg(*reshape.index_columns(NAMES, "value_mean"), *aggregate.quality_columns())
    full = joins.densify(steps.withColumn("observed", F.lit(True)), reshape.date_list(binned))
    fills = {n: F.coalesce(n, F.lit(0.0)) for n in NAMES}
    return full.withColumns(
        fills
        | {
            "observed": F.coalesce("observed", F.lit(False)),
            "cloud_scene": F.coalesce("cloud_scene", F.lit(100.0)),
            "px_count": F.coalesce("px_count", F.lit(0.0)),
        }
    )


@check("p16_of_label", "training", "SELECT parcel_id, cast(date AS varchar) AS date, idx FROM training WHERE label = 'MACHINERY'")
def _(spark, sf):
    return clean.of_label(v.training(spark, sf), "MACHINERY").select("parcel_id", "date", "idx")


@check("p17_model_columns", "training", f"SELECT {r6('value_mean', 'value')}, px_count, {r6('cloud_scene', 'cloud_scene')} FROM training")
def _(spark, sf):
    return clean.model_columns(v.training(spark, sf), ["parcel_id", "label", "label_group", "tile", "date", "idx"], {"value_mean": "value"})


PHENO = """SELECT parcel_id, idx, avg(value) AS mean FROM agg40 GROUP BY ALL"""


@check(
    "j1_join_features",
    "agg40 parcel_labels",
    f"""SELECT l.parcel_id, label, label_group, {', '.join(r6(f"avg(value) FILTER (idx = '{n}')", f'"{n}"') for n in NAMES)}
    FROM parcel_labels l JOIN agg40 a ON a.parcel_id = l.parcel_id GROUP BY ALL""",
)
def _(spark, sf):
    wide = reshape.pivot_index(cells40(spark, sf), NAMES, ["parcel_id"])
    return joins.join_features(v.parcel_labels(spark, sf), wide)


def cells40(spark, sf):
    rows = clean.min_px(clean.max_cloud(v.obs(spark, sf), 40.0), 10)
    return aggregate.weighted_mean(rows)


@check(
    "j2_add_phenology",
    "agg40 parcel_labels",
    f"""SELECT l.parcel_id, label, {', '.join(f"""{r6(f"avg(value) FILTER (idx = '{n}')", f'"{n}__mean"')}, {r6(f"max(value) FILTER (idx = '{n}')", f'"{n}__max"')}""" for n in NAMES)}
    FROM parcel_labels l LEFT JOIN agg40 USING (parcel_id) GROUP BY l.parcel_id, label""",
)
def _(spark, sf):
    stats = reshape.pivot_phenology(phenology.phenology(cells40(spark, sf)), NAMES)
    return joins.add_phenology(v.parcel_labels(spark, sf), stats).select("parcel_id", "label", *[f"{n}__{s}" for n in NAMES for s in ("mean", "max")])


@check("j4_attach_label", "obs parcel_labels", f"SELECT {OBS}, label FROM obs JOIN parcel_labels USING (parcel_id)")
def _(spark, sf):
    return joins.attach_label(v.obs(spark, sf), v.parcel_labels(spark, sf))


@check(
    "j5_attach_group",
    "obs parcel_labels",
    f"""SELECT {OBS}, coalesce(label_group, '') AS label_group FROM obs LEFT JOIN (SELECT * FROM parcel_labels WHERE label <> 'MACHINERY') USING (parcel_id)""",
)
def _(spark, sf):
    return joins.attach_group(v.obs(spark, sf), v.parcel_labels(spark, sf).where("label <> 'MACHINERY'"))


@check(
    "j6_explore_join",
    "obs labels_raw",
    r"""SELECT parcel_id, label, cast(count(*) AS bigint) AS n, """
    + r6("avg(value_mean)", "mean_value")
    + r""" FROM obs JOIN (SELECT regexp_replace(trim(parcel_id), '\.0+$', '') AS parcel_id, label FROM labels_raw) USING (parcel_id) GROUP BY ALL""",
)
def _(spark, sf):
    raw = v.labels_raw(spark, sf).select(text.normalize_id("parcel_id").alias("parcel_id"), "label")
    joined = joins.explore_join(v.obs(spark, sf), raw)
    return joined.groupBy("parcel_id", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("value_mean").alias("mean_value"))


@check(
    "j10_densify",
    "agg40",
    f"""SELECT p.parcel_id, g.t, cast(g.date AS varchar) AS date, {', '.join(r6(f'w."{n}"', f'"{n}"') for n in NAMES)} FROM (SELECT DISTINCT parcel_id FROM agg40) p
    CROSS JOIN (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM agg40)) g
    LEFT JOIN (SELECT parcel_id, date, {WIDE_SQL} FROM agg40 GROUP BY ALL) w ON w.parcel_id = p.parcel_id AND w.date = g.date""",
)
def _(spark, sf):
    agg = cells40(spark, sf)
    return joins.densify(reshape.pivot_index(agg, NAMES), reshape.date_list(agg))


@check(
    "j11_complete_columns",
    "agg40",
    f"""SELECT parcel_id, {r6("avg(value) FILTER (idx = 'VIEW' AND date = '2024-01-01')", '"2024-01-01__VIEW"')},
    {r6("CAST(NULL AS DOUBLE)", '"2024-01-01__NDVI"')},
    {r6("avg(value) FILTER (idx = 'VIEW' AND date = '2024-01-02')", '"2024-01-02__VIEW"')},
    {r6("CAST(NULL AS DOUBLE)", '"2024-01-02__NDVI"')} FROM agg40 GROUP BY 1""",
)
def _(spark, sf):
    return reshape.pivot_date_index(cells40(spark, sf), ["2024-01-01", "2024-01-02"], ["NDVI", "VIEW"])


@check(
    "r6_concat",
    "obs",
    f"SELECT {OBS} FROM obs WHERE cloud_scene <= 30 UNION ALL SELECT {OBS} FROM obs WHERE px_count >= 50",
)
def _(spark, sf):
    rows = v.obs(spark, sf)
    return joins.concat([rows.where("cloud_scene <= 30"), rows.where("px_count >= 50")])


@check("r8_first_label", "labels_raw", "SELECT parcel_id, label FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY input_seq) AS rn FROM labels_raw) WHERE rn = 1")
def _(spark, sf):
    return aggregate.first_label(v.labels_raw(spark, sf))


@check(
    "r9_encode_labels",
    "parcel_labels",
    """SELECT parcel_id, label, label_group, dense_rank() OVER (ORDER BY label) - 1 AS label_id,
    CASE label_group WHEN 'G1' THEN 0 WHEN 'G2' THEN 1 ELSE -100 END AS group_id FROM parcel_labels""",
)
def _(spark, sf):
    return encode.encode_labels(encode.encode_labels(v.parcel_labels(spark, sf)), "label_group", "group_id")


@check(
    "a6_consolidate_labels",
    "labels_raw",
    r"""SELECT parcel_id, label FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY n DESC, label) AS rn FROM
    (SELECT regexp_replace(trim(parcel_id), '\.0+$', '') AS parcel_id, trim(label) AS label, count(*) AS n FROM labels_raw GROUP BY ALL)) WHERE rn = 1""",
)
def _(spark, sf):
    return aggregate.consolidate_labels(v.labels_raw(spark, sf))


@check(
    "a6_mode_text",
    "obs",
    """SELECT tile, cast(date AS varchar) AS date, idx AS top_idx FROM (SELECT *, row_number() OVER (PARTITION BY tile, date ORDER BY n DESC, idx) AS rn
    FROM (SELECT tile, date, idx, count(*) AS n FROM obs GROUP BY ALL)) WHERE rn = 1""",
)
def _(spark, sf):
    return v.obs(spark, sf).groupBy("tile", "date").agg(text.mode_text("idx").alias("top_idx"))
