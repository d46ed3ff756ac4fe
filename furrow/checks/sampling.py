"""Queries over class tables, splits, resampling and augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.checks import views as v
from furrow.checks.cleaning import NAMES, dense
from furrow.checks.registry import check
from furrow.checks.views import r6
from furrow.functions import draws
from furrow.functions.quality import quality_struct
from furrow.operators import aggregate, encode, sampling, splits

TRAIN = "(SELECT * FROM parcel_labels WHERE cast(parcel_id AS int) % 3 <> 0 AND label <> 'FURNITURE')"


def train(spark, sf):
    return v.parcel_labels(spark, sf).where("cast(parcel_id AS int) % 3 <> 0 AND label <> 'FURNITURE'")


def classes(spark, sf):
    return v.parcel_labels(spark, sf).select("label").distinct()


GRID = f"SELECT label, count(t.parcel_id) AS n FROM (SELECT DISTINCT label FROM parcel_labels) LEFT JOIN {TRAIN} t USING (label) GROUP BY 1"


@check("f28_balanced_weight", "parcel_labels", f"SELECT parcel_id, label, {r6('(sum(1) OVER ()) / ((SELECT count(DISTINCT label) FROM parcel_labels) * (count(*) OVER (PARTITION BY label)))', 'weight')} FROM parcel_labels")
def _(spark, sf):
    return encode.balanced_weight(v.parcel_labels(spark, sf)).select("parcel_id", "label", "weight")


@check(
    "f29_class_weight",
    "parcel_labels",
    f"""WITH g AS ({GRID}), w AS (SELECT label, n, least(greatest(pow((sum(greatest(n, 1)) OVER ()) / ((count(*) OVER ()) * greatest(n, 1)), 0.5), 0.6), 4) AS w FROM g)
    SELECT label, n, {r6('w / (avg(w) OVER ())', 'weight')} FROM w""",
)
def _(spark, sf):
    return encode.class_weight(train(spark, sf), classes(spark, sf), power=0.5, low=0.6, high=4.0)


@check(
    "f30_sampling_weight",
    "parcel_labels",
    f"""WITH g AS ({GRID}), w AS (SELECT label, n, pow(1 / greatest(n, 1), 0.5) AS w FROM g) SELECT label, n, {r6('w / (avg(w) OVER ())', 'weight')} FROM w""",
)
def _(spark, sf):
    return encode.sampling_weight(train(spark, sf), classes(spark, sf), power=0.5)


RARE = f"""g AS ({GRID}), cut AS (SELECT quantile_cont(n, 0.25) AS c FROM g WHERE n > 0), rare AS (SELECT label, n, c FROM g, cut WHERE n <= c)"""


@check("a19_rare_classes", "parcel_labels", f"WITH {RARE} SELECT label, n, {r6('c', 'threshold')} FROM rare")
def _(spark, sf):
    return encode.rare_classes(encode.class_grid(train(spark, sf), classes(spark, sf), "label"))


@check(
    "f31_rare_weight",
    "parcel_labels",
    f"""WITH {RARE}, r AS (SELECT label, pow(1 / greatest(n, 1), 0.5) AS w FROM rare)
    SELECT label, g.n, {r6('coalesce(3 * r.w / (SELECT avg(w) FROM r), 1)', 'weight')} FROM g LEFT JOIN r USING (label)""",
)
def _(spark, sf):
    rare = encode.rare_classes(encode.class_grid(train(spark, sf), classes(spark, sf), "label"))
    return encode.rare_weight(train(spark, sf), classes(spark, sf), rare, power=0.5, boost=3.0)


@check("a25_class_priors", "parcel_labels", f"WITH g AS ({GRID}) SELECT label, greatest(n, 1) AS n, {r6('greatest(n, 1) / (sum(greatest(n, 1)) OVER ())', 'prior')} FROM g")
def _(spark, sf):
    return encode.class_priors(train(spark, sf), classes(spark, sf))


COMPAT = f"""WITH ids AS (SELECT parcel_id, label, label_group, dense_rank() OVER (ORDER BY label) - 1 AS label_id,
    CASE WHEN label_group = '' THEN -100 WHEN cast(parcel_id AS int) % 4 = 0 THEN 1 - (label_group = 'G2')::int ELSE (label_group = 'G2')::int END AS group_id FROM parcel_labels),
    t AS (SELECT * FROM ids WHERE cast(parcel_id AS int) % 3 <> 0 AND label <> 'FURNITURE'),
    cells AS (SELECT c.label_id, g.group_id, count(t.parcel_id) AS n FROM (SELECT DISTINCT label_id FROM ids) c CROSS JOIN (SELECT DISTINCT group_id FROM ids WHERE group_id >= 0) g
      LEFT JOIN t ON t.label_id = c.label_id AND t.group_id = g.group_id GROUP BY ALL),
    compat AS (SELECT label_id, group_id, n, CASE WHEN (sum(n) OVER p) > 0 THEN n / (sum(n) OVER p) ELSE 0.5 END AS share FROM cells WINDOW p AS (PARTITION BY label_id))"""


def compat(spark, sf):
    ids = encode.encode_labels(encode.encode_labels(v.parcel_labels(spark, sf)), "label_group", "group_id")
    swapped = F.when((F.col("group_id") >= 0) & (F.col("parcel_id").cast("int") % 4 == 0), 1 - F.col("group_id")).otherwise(F.col("group_id"))
    ids = ids.withColumn("group_id", swapped)
    rows = ids.where("cast(parcel_id AS int) % 3 <> 0 AND label <> 'FURNITURE'")
    return encode.class_group_compat(rows, ids.select("label_id").distinct(), ids.where("group_id >= 0").select("group_id").distinct())


@check("a18_class_group_compat", "parcel_labels", f"{COMPAT} SELECT label_id, group_id, n, {r6('share', 'share')} FROM compat")
def _(spark, sf):
    return compat(spark, sf)


@check(
    "a18_compat_summary",
    "parcel_labels",
    f"""{COMPAT} SELECT sum(n)::BIGINT AS valid_samples, count(*) FILTER (n = 0) AS missing_classes, {r6('avg(links)', 'mean_links_per_class')}, max(links) AS max_links_per_class
    FROM (SELECT label_id, sum(n) AS n, count(*) FILTER (share > 0) AS links FROM compat GROUP BY 1)""",
)
def _(spark, sf):
    return encode.compat_summary(compat(spark, sf))


def allot_sql(source: str, n: str, total: str, out: str, over: str = "") -> str:
    """Largest-remainder shares of ``total`` in proportion to ``n``, per ``over``."""
    p = f"PARTITION BY {over}" if over else ""
    return f"""SELECT * EXCLUDE (sh, fl, tot), (fl + (row_number() OVER ({p} ORDER BY sh - fl DESC, label) <= tot - (sum(fl) OVER ({p})))::int)::BIGINT AS {out}
    FROM (SELECT *, floor(sh) AS fl FROM (SELECT *, {total} AS tot, {n} * ({total}) / (sum({n}) OVER ({p}))::DOUBLE AS sh FROM {source}))"""


def hashed(key: str, seed: str) -> str:
    return f"md5({key} || '|' || '{seed}')"


X1 = f"""WITH c AS (SELECT label, count(*) AS n FROM parcel_labels GROUP BY 1),
    k AS ({allot_sql('c', 'n', '(SELECT ceil(sum(n) * 0.2::DOUBLE) FROM c)', 'k')}),
    s AS (SELECT parcel_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {hashed('parcel_id', '42')}, parcel_id) <= k THEN 'test' ELSE 'train' END AS split
      FROM parcel_labels JOIN k USING (label))"""


@check("x1_stratified_split", "parcel_labels", f"{X1} SELECT parcel_id, label, split FROM s")
def _(spark, sf):
    return splits.stratified_split(v.parcel_labels(spark, sf)).select("parcel_id", "label", "split")


X2 = f"""c AS (SELECT label, count(*) AS n FROM base GROUP BY 1),
    k1 AS ({allot_sql('c', 'n', '(SELECT ceil(sum(n) * 0.2::DOUBLE) FROM c)', 'kt')}),
    k2 AS ({allot_sql('(SELECT *, n - kt AS rem FROM k1)', 'rem', '(SELECT ceil(sum(n - kt) * (0.1::DOUBLE / (1.0::DOUBLE - 0.2::DOUBLE))) FROM k1)', 'kv')}),
    s AS (SELECT parcel_id, base.label, CASE WHEN rn <= kt THEN 'test' WHEN rn <= kt + kv THEN 'val' ELSE 'train' END AS split FROM
      (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hashed('parcel_id', '42')}, parcel_id) AS rn FROM base) base JOIN k2 USING (label))"""


@check("x2_split_by_parcel", "parcel_labels", f"WITH base AS (SELECT parcel_id, label FROM parcel_labels), {X2} SELECT parcel_id, label, split FROM s")
def _(spark, sf):
    return splits.split_by_parcel(v.parcel_labels(spark, sf)).select("parcel_id", "label", "split")


@check(
    "x2_split_by_parcel_plain",
    "parcel_labels",
    f"""WITH n AS (SELECT count(*) AS n, ceil(count(*) * 0.2::DOUBLE) AS kt FROM parcel_labels)
    SELECT parcel_id, CASE WHEN rn <= kt THEN 'test' WHEN rn <= kt + ceil((n - kt) * (0.1::DOUBLE / (1.0::DOUBLE - 0.2::DOUBLE))) THEN 'val' ELSE 'train' END AS split
    FROM (SELECT parcel_id, row_number() OVER (ORDER BY {hashed('parcel_id', '7')}, parcel_id) AS rn FROM parcel_labels), n""",
)
def _(spark, sf):
    return splits.split_by_parcel(v.parcel_labels(spark, sf), seed=7, stratify=False).select("parcel_id", "split")


@check(
    "x3_inner_val_split",
    "parcel_labels",
    f"""{X1}, tr AS (SELECT * FROM s WHERE split = 'train'), ci AS (SELECT label, count(*) AS n FROM tr GROUP BY 1),
    ki AS ({allot_sql('ci', 'n', '(SELECT ceil(sum(n) * 0.15::DOUBLE) FROM ci)', 'k')})
    SELECT parcel_id, tr.label, CASE WHEN row_number() OVER (PARTITION BY tr.label ORDER BY {hashed('parcel_id', '42')}, parcel_id) <= k THEN 'val' ELSE 'fit' END AS split
    FROM tr JOIN ki USING (label)""",
)
def _(spark, sf):
    rows = splits.stratified_split(v.parcel_labels(spark, sf)).where("split = 'train'").drop("split")
    return splits.inner_val_split(rows).select("parcel_id", "label", "split")


def tiled(spark, sf):
    return v.training(spark, sf).select("parcel_id", "label", "tile").distinct()


TILED = "tiled AS (SELECT DISTINCT parcel_id, label, tile FROM training)"


@check(
    "x4_split_by_tile",
    "training",
    f"""WITH {TILED}, t AS (SELECT tile, count(*) AS n, row_number() OVER (ORDER BY tile) - 1 AS j FROM tiled GROUP BY 1), m AS (SELECT count(*) AS k, sum(n)::DOUBLE AS total FROM t),
    d AS (SELECT id, t.tile, t.n, (id // (pow(3, k - 1 - j)::BIGINT)) % 3 AS digit FROM m, range(0, (SELECT pow(3, k)::BIGINT FROM m)) AS r(id), t),
    sc AS (SELECT id, sum(n) FILTER (digit = 0) AS a, sum(n) FILTER (digit = 1) AS b, sum(n) FILTER (digit = 2) AS c FROM d GROUP BY id),
    best AS (SELECT id FROM sc, m WHERE a > 0 AND b > 0 AND c > 0
      ORDER BY abs(a / total - (1.0::DOUBLE - 0.2::DOUBLE - 0.1::DOUBLE)) + abs(c / total - 0.2::DOUBLE) + abs(b / total - 0.1::DOUBLE), id LIMIT 1)
    SELECT parcel_id, tiled.tile, CASE digit WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM tiled JOIN (SELECT d.* FROM d JOIN best USING (id)) x ON x.tile = tiled.tile""",
)
def _(spark, sf):
    return splits.split_by_tile(tiled(spark, sf)).select("parcel_id", "tile", "split")


@check("x5_create_splits", "parcel_labels", f"WITH base AS (SELECT parcel_id, label FROM parcel_labels), {X2} SELECT split, count(*) AS n FROM s GROUP BY 1")
def _(spark, sf):
    return splits.create_splits(v.parcel_labels(spark, sf), "parcel").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


FOLDS = f"""WITH RECURSIVE {TILED}, ord AS (SELECT tile, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, tile) AS i FROM tiled GROUP BY 1),
    walk AS (SELECT 0::BIGINT AS i, [0, 0, 0]::BIGINT[] AS loads, NULL::VARCHAR AS tile, 0::BIGINT AS n, 0::INTEGER AS fold
      UNION ALL SELECT o.i, list_transform(loads, lambda x, j: CASE WHEN j = list_position(loads, list_min(loads)) THEN x + o.n ELSE x END),
        o.tile, o.n, list_position(loads, list_min(loads))::INTEGER FROM walk JOIN ord o ON o.i = walk.i + 1)"""


@check("x6_group_folds", "training", f"{FOLDS} SELECT tile, fold AS test_fold, n FROM walk WHERE i > 0")
def _(spark, sf):
    return splits.group_folds(tiled(spark, sf), "tile", 3)


@check(
    "x6_group_kfold",
    "training",
    f"""{FOLDS}, r AS (SELECT f.fold, parcel_id, t.tile, label, w.fold AS test_fold FROM tiled t JOIN walk w ON w.tile = t.tile CROSS JOIN (SELECT unnest([1, 2, 3]) AS fold) f),
    c AS (SELECT fold, label, count(*) AS n FROM r WHERE fold <> test_fold GROUP BY ALL),
    ct AS (SELECT *, ceil((sum(n) OVER (PARTITION BY fold)) * 0.1::DOUBLE) AS kk FROM c),
    k AS ({allot_sql('ct', 'n', 'kk', 'k', 'fold')})
    SELECT r.fold, parcel_id, tile, label, CASE WHEN r.fold = test_fold THEN 'test' WHEN row_number() OVER (PARTITION BY r.fold, r.fold = test_fold, label
      ORDER BY md5(parcel_id || '|' || (42 + r.fold)), parcel_id) <= k THEN 'val' ELSE 'train' END AS split FROM r JOIN k USING (fold, label)""",
)
def _(spark, sf):
    return splits.group_kfold(tiled(spark, sf), "tile", 3, 0.1, 42)


@check(
    "x7_stratified_kfold",
    "parcel_labels",
    f"""SELECT parcel_id, label, (row_number() OVER (PARTITION BY label ORDER BY {hashed('parcel_id', '42')}, parcel_id) - 1) * 5 // (count(*) OVER (PARTITION BY label)) AS fold FROM parcel_labels""",
)
def _(spark, sf):
    return splits.stratified_kfold(v.parcel_labels(spark, sf)).select("parcel_id", "label", "fold")


def unit(expr: str, seed: str) -> str:
    return f"(('0x' || substr(md5({expr} || '|' || '{seed}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def resample_sql(weights: str) -> str:
    return f"""WITH {weights}, c AS (SELECT label, count(*) AS n FROM {TRAIN} GROUP BY 1),
    m AS (SELECT label, c.n, sum(c.n * weight) OVER (ORDER BY label) AS hi FROM c JOIN w USING (label)),
    d AS (SELECT i AS draw, {unit('i', '42c')} * (SELECT max(hi) FROM m) AS spot, {unit('i', '42r')} AS u FROM range(0, (SELECT sum(n)::BIGINT FROM c)) AS r(i)),
    p AS (SELECT draw, arg_min(label, hi) AS label, floor(any_value(u) * arg_min(n, hi)) + 1 AS rank FROM d JOIN m ON hi > spot GROUP BY 1)
    SELECT draw, parcel_id, label FROM p JOIN (SELECT parcel_id, label, row_number() OVER (PARTITION BY label ORDER BY {hashed('parcel_id', '42')}, parcel_id) AS rank FROM {TRAIN}) USING (label, rank)"""


@check(
    "x8_weighted_resample",
    "parcel_labels",
    resample_sql(f"g AS ({GRID}), w AS (SELECT label, s / (avg(s) OVER ()) AS weight FROM (SELECT label, pow(1 / greatest(n, 1), 0.5) AS s FROM g))"),
)
def _(spark, sf):
    return sampling.weighted_resample(train(spark, sf), classes(spark, sf), 0.5).select("draw", "parcel_id", "label")


@check(
    "x9_rare_resample",
    "parcel_labels",
    resample_sql(
        f"{RARE}, r AS (SELECT label, pow(1 / greatest(n, 1), 0.5) AS w FROM rare), w AS (SELECT label, coalesce(3 * r.w / (SELECT avg(w) FROM r), 1) AS weight FROM g LEFT JOIN r USING (label))"
    ),
)
def _(spark, sf):
    rare = encode.rare_classes(encode.class_grid(train(spark, sf), classes(spark, sf), "label"))
    return sampling.rare_resample(train(spark, sf), classes(spark, sf), rare, 0.5, 3.0).select("draw", "parcel_id", "label")


@check(
    "x8_weight_summary",
    "parcel_labels",
    f"""WITH g AS ({GRID}), w AS (SELECT label, s / (avg(s) OVER ()) AS weight FROM (SELECT label, pow(1 / greatest(n, 1), 0.5) AS s FROM g)), x AS (SELECT weight FROM {TRAIN} JOIN w USING (label))
    SELECT {r6('min(weight)', 'min_sample_weight')}, {r6('max(weight)', 'max_sample_weight')}, {r6('avg(weight)', 'mean_sample_weight')} FROM x""",
)
def _(spark, sf):
    return sampling.weight_summary(train(spark, sf), encode.sampling_weight(train(spark, sf), classes(spark, sf), power=0.5))


@check(
    "x10_mask_time_steps",
    "cells",
    f"""WITH r AS (SELECT *, count(*) FILTER (observed) OVER (PARTITION BY parcel_id) AS n, row_number() OVER (PARTITION BY parcel_id, observed ORDER BY md5(parcel_id || '|' || t || '|42'), t) AS rn FROM cells),
    h AS (SELECT *, observed AND rn <= greatest(1, least(n, round_even(n * 0.3::DOUBLE, 0))) AS hit FROM r)
    SELECT parcel_id, t, observed AND NOT hit AS observed, {', '.join(r6(f'CASE WHEN hit THEN 0 ELSE "{n}" END', f'"{n}"') for n in NAMES)} FROM h""",
)
def _(spark, sf):
    return sampling.mask_time_steps(dense(spark, sf), NAMES, 0.3).select("parcel_id", "t", "observed", *NAMES)


STEP = "parcel_id || '|' || t"


@check(
    "x11_jitter",
    "cells",
    "SELECT parcel_id, t, "
    + ", ".join(
        r6(f"""CASE WHEN observed THEN "{n}" + 0.1 * sqrt(-2 * ln(1 - {unit(STEP, f'42{n}a')})) * cos(2 * pi() * {unit(STEP, f'42{n}b')}) ELSE "{n}" END""", f'"{n}"')
        for n in NAMES
    )
    + " FROM cells",
)
def _(spark, sf):
    return sampling.jitter(dense(spark, sf), NAMES, 0.1).select("parcel_id", "t", *NAMES)


SSL = f"""WITH u AS (SELECT *, {unit("parcel_id || '|' || t", '42')} AS u FROM cells),
    h AS (SELECT *, observed AND u < 0.1 AS hit, row_number() OVER (PARTITION BY parcel_id, observed ORDER BY u, t) AS rn FROM u),
    mk AS (SELECT *, hit OR (observed AND rn = 1 AND NOT (bool_or(hit) OVER (PARTITION BY parcel_id))) AS masked FROM h)"""


@check("x12_ssl_mask", "cells", f"{SSL} SELECT parcel_id, t, masked FROM mk")
def _(spark, sf):
    return sampling.ssl_mask(dense(spark, sf), 0.1).select("parcel_id", "t", "masked")


@check(
    "x12_apply_ssl_mask",
    "cells",
    f"""{SSL}, q AS (SELECT *, observed AND NOT masked AS seen, least(greatest(cloud_scene / 100, 0), 1) AS c, least(greatest(ln(1 + greatest(px_count, 0)) / ln(257), 0), 1) AS p FROM mk)
    SELECT parcel_id, t, seen AS observed, {', '.join(r6(f'CASE WHEN masked THEN 0 ELSE "{n}" END', f'"{n}"') for n in NAMES)}, {r6('CASE WHEN seen THEN (1 - c) * sqrt(p) ELSE 0 END', 'reliability')},
    {r6('CASE WHEN seen THEN c ELSE 1 END', 'cloud_norm')}, {r6('CASE WHEN seen THEN p ELSE 0 END', 'px_norm')} FROM q""",
)
def _(spark, sf):
    q = quality_struct(F.col("observed"), F.col("cloud_scene"), F.col("px_count"))
    rows = dense(spark, sf).withColumn("q", q).select("parcel_id", "t", "observed", *NAMES, "q.*")
    return sampling.apply_ssl_mask(sampling.ssl_mask(rows, 0.1), NAMES).drop("masked")


@check(
    "a24_reconstruction_error",
    "cells",
    f"""{SSL}, e AS (SELECT parcel_id, t, unnest([{', '.join(f'"{n}"' for n in NAMES)}]) * 0.1 AS gap FROM mk WHERE masked)
    SELECT {r6('avg(gap * gap)', 'loss')}, {r6('avg(abs(gap))', 'mae')}, {r6('sqrt(avg(gap * gap))', 'rmse')}, count(DISTINCT (parcel_id, t)) AS masked_tokens FROM e""",
)
def _(spark, sf):
    rows = sampling.ssl_mask(dense(spark, sf), 0.1)
    cells = rows.select("parcel_id", "t", "masked", F.explode(F.array(*NAMES)).alias("target"))
    return aggregate.reconstruction_error(cells.withColumn("predicted", F.col("target") * 0.9))


@check("draw_uniform", "obs", f"SELECT event_id, {r6(unit('event_id', '42'), 'u')} FROM events")
def _(spark, sf):
    return v.table(spark, sf, "events").select("event_id", draws.uniform(42, "event_id").alias("u"))
