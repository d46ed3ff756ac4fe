"""Queries over predictions, class scores, losses, ensembles and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.checks import views as v
from furrow.checks.registry import check
from furrow.checks.views import r6, r6s
from furrow.functions import logits as L
from furrow.operators import aggregate, encode, ensemble, evaluate, models, oversample, reshape, splits
from furrow.operators.exact_tree import fit_exact_tree
from furrow.operators.neighbours import nearest_neighbours

LABELS = "labels_of AS (SELECT y_true AS label FROM preds UNION SELECT y_pred FROM preds UNION SELECT 10)"


def labels(spark, sf):
    """Class dictionary, with one class that never occurs."""
    p = v.preds(spark, sf)
    extra = p.select(F.lit(10).alias("label"))
    return p.select(F.col("y_true").alias("label")).union(p.select("y_pred")).union(extra).distinct()


def per_class(source: str, by: str = "") -> str:
    """Counts and scores per class that occurs, as CTE ``pc``."""
    g = f"{by}, " if by else ""
    j = f"USING ({g}label)"
    return f"""tt AS (SELECT {g}y_true AS label, count(*) AS support, count(*) FILTER (y_true = y_pred) AS tp FROM {source} GROUP BY ALL),
    pp AS (SELECT {g}y_pred AS label, count(*) AS predicted FROM {source} GROUP BY ALL),
    pc AS (SELECT {g}label, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted,
      coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall,
      2 * coalesce(tp, 0) / (coalesce(support, 0) + coalesce(predicted, 0)) AS f1 FROM tt FULL JOIN pp {j})"""


SCALARS = f"""sum(support)::BIGINT AS n, {r6('sum(tp) / sum(support)', 'accuracy')}, {r6('avg(recall) FILTER (support > 0)', 'balanced_accuracy')},
    {r6('avg(precision)', 'precision_macro')}, {r6('avg(recall)', 'recall_macro')}, {r6('avg(f1)', 'f1_macro')},
    {r6('sum(recall * support) / sum(support)', 'recall_weighted')}, {r6('sum(f1 * support) / sum(support)', 'f1_weighted')}"""


@check("e1_scalar_metrics", "preds", f"WITH {per_class('preds')} SELECT {SCALARS} FROM pc")
def _(spark, sf):
    return evaluate.scalar_metrics(v.preds(spark, sf))


@check("e1_scalar_metrics_by_split", "preds", f"WITH {per_class('preds', 'split')} SELECT split, {SCALARS} FROM pc GROUP BY split")
def _(spark, sf):
    return evaluate.scalar_metrics(v.preds(spark, sf), by=["split"])


REPORT = f"""{LABELS}, {per_class('preds')}, full_pc AS (SELECT label, coalesce(tp, 0) AS tp, coalesce(support, 0) AS support, coalesce(precision, 0) AS precision,
    coalesce(recall, 0) AS recall, coalesce(f1, 0) AS f1 FROM labels_of LEFT JOIN pc USING (label))"""
REPORT_ROWS = f"""SELECT 0 AS kind, cast(label AS varchar) AS name, {r6s('precision recall f1')}, support FROM full_pc
    UNION ALL SELECT 1, 'accuracy', {r6('sum(tp) / sum(support)', 'precision')}, {r6('sum(tp) / sum(support)', 'recall')}, {r6('sum(tp) / sum(support)', 'f1')}, sum(support)::BIGINT FROM full_pc
    UNION ALL SELECT 2, 'macro avg', {r6('avg(precision)', 'precision')}, {r6('avg(recall)', 'recall')}, {r6('avg(f1)', 'f1')}, sum(support)::BIGINT FROM full_pc
    UNION ALL SELECT 3, 'weighted avg', {', '.join(r6(f'sum({c} * support) / sum(support)', c) for c in ('precision', 'recall', 'f1'))}, sum(support)::BIGINT FROM full_pc"""


@check("e2_class_report", "preds", f"WITH {REPORT} {REPORT_ROWS}")
def _(spark, sf):
    return evaluate.class_report(v.preds(spark, sf), labels(spark, sf))


@check(
    "s13_report_text",
    "preds",
    f"""WITH {REPORT}, r AS ({REPORT_ROWS}), l AS (
    SELECT kind, name, CASE WHEN kind = 1 THEN printf('%12s  %9s %9s %9.2f %9d', name, '', '', f1, support)
      ELSE printf('%12s  %9.2f %9.2f %9.2f %9d', name, precision, recall, f1, support) END AS line FROM r
    UNION ALL SELECT -2, '', printf('%12s  %9s %9s %9s %9s', '', 'precision', 'recall', 'f1-score', 'support') UNION ALL SELECT -1, '', '' UNION ALL SELECT 1, '', '')
    SELECT row_number() OVER (ORDER BY kind, name) - 1 AS pos, line FROM l""",
)
def _(spark, sf):
    return evaluate.report_text(evaluate.class_report(v.preds(spark, sf), labels(spark, sf)))


@check(
    "s7_metrics_row",
    "preds",
    f"WITH {per_class('preds')} SELECT json_extract_string(to_json(struct_pack(n := sum(support)::BIGINT)), '$.n') AS n, {r6('sum(tp) / sum(support)', 'accuracy')} FROM pc",
)
def _(spark, sf):
    from furrow.sources.writers import metrics_row

    row = metrics_row(evaluate.scalar_metrics(v.preds(spark, sf)))
    return row.select(F.get_json_object("value", "$.n").alias("n"), F.get_json_object("value", "$.accuracy").cast("double").alias("accuracy"))


CM = f"{LABELS}, cm AS (SELECT a.label AS t, b.label AS p, count(id) AS n FROM labels_of a CROSS JOIN labels_of b LEFT JOIN preds ON y_true = a.label AND y_pred = b.label GROUP BY ALL)"


def cm(spark, sf):
    return evaluate.confusion(v.preds(spark, sf), labels(spark, sf))


@check("e3_confusion", "preds", f"WITH {CM} SELECT t, p, n FROM cm")
def _(spark, sf):
    return cm(spark, sf)


@check("e3_confusion_wide", "preds", f"WITH {CM} SELECT t, " + ", ".join(f'sum(n) FILTER (p = {k})::BIGINT AS "{k}"' for k in range(11)) + " FROM cm GROUP BY t")
def _(spark, sf):
    return evaluate.confusion_wide(cm(spark, sf), list(range(11)))


@check("e4_confusion_normalised", "preds", f"WITH {CM} SELECT t, p, {r6('coalesce(n / nullif(sum(n) OVER (PARTITION BY t), 0), 0)', 'share')} FROM cm")
def _(spark, sf):
    return evaluate.confusion_normalised(cm(spark, sf))


@check(
    "e5_error_analysis",
    "preds",
    f"""WITH {CM}, w AS (SELECT t, p, n, row_number() OVER (PARTITION BY t ORDER BY n DESC, p) AS rn FROM cm WHERE t <> p AND n > 0)
    SELECT cm.t AS class_name, sum(cm.n)::BIGINT AS support, sum(CASE WHEN cm.t = cm.p THEN cm.n ELSE 0 END)::BIGINT AS true_positive,
    sum(CASE WHEN cm.t <> cm.p THEN cm.n ELSE 0 END)::BIGINT AS false_negative, any_value(w.p) AS main_confusion_target, coalesce(any_value(w.n), 0) AS main_confusion_count
    FROM cm LEFT JOIN w ON w.t = cm.t AND w.rn = 1 GROUP BY cm.t""",
)
def _(spark, sf):
    return evaluate.error_analysis(cm(spark, sf))


@check(
    "e6_compare_splits",
    "preds",
    f"""WITH {per_class('preds', 'split')} SELECT split, {r6('sum(tp) / sum(support)', 'accuracy')}, {r6('avg(precision)', 'precision_macro')}, {r6('avg(recall)', 'recall_macro')},
    {r6('sum(f1 * support) / sum(support)', 'f1_weighted')}, {r6('avg(f1)', 'f1_macro')} FROM pc GROUP BY split""",
)
def _(spark, sf):
    return evaluate.compare_splits(v.preds(spark, sf))


WEIGHTS = f"""{per_class('preds', 'split')}, sc AS (SELECT split AS model, avg(f1) AS score FROM pc GROUP BY split)"""


def run_models(spark, sf):
    runs = evaluate.scalar_metrics(v.preds(spark, sf), by=["split"])
    return runs.select(F.col("split").alias("model"), F.col("f1_macro").alias("val_f1"), F.lit(None).cast("double").alias("best_metric"))


@check("e8_ensemble_weights", "preds", f"WITH {WEIGHTS} SELECT model, {r6('score', 'score')}, {r6('score * score / (sum(score * score) OVER ())', 'weight')} FROM sc")
def _(spark, sf):
    return ensemble.ensemble_weights(run_models(spark, sf), 2.0)


MODEL_WEIGHTS = "mw AS (SELECT m, (m + 1) / 6.0::DOUBLE AS w FROM (SELECT unnest(range(0, 3)) AS m))"


@check(
    "e7_ensemble",
    "logit_cells",
    f"""WITH {MODEL_WEIGHTS}, s AS (SELECT id, k, sum(w * x) AS x FROM logit_cells JOIN mw USING (m) GROUP BY ALL),
    top AS (SELECT id, k AS y_pred FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x DESC, k) AS rn FROM s) WHERE rn = 1)
    SELECT id, k, {r6('x', 'x')}, y_pred FROM s JOIN top USING (id)""",
)
def _(spark, sf):
    table = v.logits(spark, sf)
    weights = table.select("model").distinct().withColumn("weight", (F.substring("model", 2, 1).cast("int") + 1) / 6.0)
    out = ensemble.ensemble(table, weights)
    return out.select("id", F.posexplode("logits").alias("k", "x"), "y_pred")


@check(
    "e9_decode_predictions",
    "preds",
    "SELECT id, y_true, y_pred, concat('class_', y_true) AS y_true_label, concat('class_', y_pred) AS y_pred_label FROM preds",
)
def _(spark, sf):
    names = labels(spark, sf).select(F.col("label").alias("label_id"), F.concat(F.lit("class_"), F.col("label").cast("string")).alias("label"))
    return evaluate.decode_predictions(v.preds(spark, sf), names).select("id", "y_true", "y_pred", "y_true_label", "y_pred_label")


@check(
    "t4_rank_runs",
    "preds",
    f"""WITH {per_class('preds', 'split')} SELECT split AS run, {r6("CASE WHEN split = 'val' THEN NULL ELSE avg(f1) END", 'test_macro_f1')} FROM pc GROUP BY split""",
)
def _(spark, sf):
    runs = evaluate.scalar_metrics(v.preds(spark, sf), by=["split"])
    return evaluate.rank_runs(runs.select(F.col("split").alias("run"), F.when(F.col("split") != "val", F.col("f1_macro")).alias("test_macro_f1")))


@check(
    "a22_fold_summary",
    "preds",
    f"""WITH f AS (SELECT *, id % 5 AS fold FROM preds), {per_class('f', 'fold')}, sc AS (SELECT fold, avg(f1) AS score FROM pc GROUP BY fold)
    SELECT count(*) AS n_folds, {r6('avg(score)', 'score_mean')}, {r6('stddev_pop(score)', 'score_std')} FROM sc WHERE fold <> 3""",
)
def _(spark, sf):
    runs = evaluate.scalar_metrics(v.preds(spark, sf).withColumn("fold", F.col("id") % 5), by=["fold"])
    return aggregate.fold_summary(runs.select(F.when(F.col("fold") != 3, F.col("f1_macro")).alias("score")))


@check(
    "r7_concat_history",
    "obs",
    f"""WITH h AS (SELECT cast(dayofyear(date) AS double) AS epoch, avg(value_mean) AS loss FROM obs GROUP BY 1)
    SELECT {r6s('epoch loss')} FROM (SELECT * FROM h UNION ALL SELECT epoch + (SELECT count(*) FROM h), loss FROM h WHERE epoch <= 9)""",
)
def _(spark, sf):
    h = v.obs(spark, sf).groupBy(F.dayofyear("date").cast("double").alias("epoch")).agg(F.avg("value_mean").alias("loss"))
    return reshape.concat_history(h, h.where("epoch <= 9"))


# Row-wise score functions: softmax terms of every model's row (its own id each), as CTE ``sm``.
SM = """sm AS (SELECT id, y, k, x, exp(x - max(x) OVER w) / sum(exp(x - m0)) OVER w AS p, x - (m0 + ln(sum(exp(x - m0)) OVER w)) AS lp
    FROM (SELECT *, max(x) OVER (PARTITION BY id) AS m0 FROM (SELECT id * 3 + m AS id, y, k, x FROM logit_cells)) WINDOW w AS (PARTITION BY id))"""


def all_models(spark, sf):
    model = F.substring("model", 2, 1).cast("int")
    return v.logits(spark, sf).select((F.col("id") * 3 + model).alias("id"), "y", F.col("logits").alias("x"))


def first_model(spark, sf):
    return v.logits(spark, sf).where("model = 'm0'").select("id", "y", F.col("logits").alias("x"))


@check(
    "f20_softmax",
    "logit_cells",
    f"WITH {SM} SELECT id, k, {r6('p', 'p')}, {r6('lp', 'lp')}, first_value(k) OVER (PARTITION BY id ORDER BY x DESC, k) AS top FROM sm",
)
def _(spark, sf):
    x = F.col("x")
    rows = all_models(spark, sf).select("id", F.posexplode(F.arrays_zip(L.softmax(x).alias("p"), L.log_softmax(x).alias("lp"))).alias("k", "_z"), L.argmax(x).alias("top"))
    return rows.select("id", "k", "_z.p", "_z.lp", "top")


@check("f21_cross_entropy", "logit_cells", f"WITH {SM} SELECT id, {r6('-lp', 'loss')}, {r6('-lp * (y + 1) / 10', 'weighted')} FROM sm WHERE k = y")
def _(spark, sf):
    x, y = F.col("x"), F.col("y")
    return all_models(spark, sf).select("id", L.cross_entropy(x, y).alias("loss"), L.cross_entropy(x, y, (y + 1) / 10).alias("weighted"))


@check("f21_weighted_mean_loss", "logit_cells", f"WITH {SM} SELECT {r6('sum(-lp * (y + 1) / 10) / sum((y + 1) / 10)', 'loss')} FROM sm WHERE k = y")
def _(spark, sf):
    w = (F.col("y") + 1) / 10
    rows = all_models(spark, sf).select(L.cross_entropy(F.col("x"), F.col("y"), w).alias("loss"), w.alias("w"))
    return rows.agg(L.weighted_mean_loss(F.col("loss"), F.col("w")).alias("loss"))


@check("f22_focal_loss", "logit_cells", f"WITH {SM} SELECT id, {r6('CASE WHEN y <> 3 THEN -pow(greatest(1 - p, 0), 2) * lp * (y + 1) / 10 END', 'loss')} FROM sm WHERE k = y")
def _(spark, sf):
    x, y = F.col("x"), F.col("y")
    return all_models(spark, sf).select("id", L.focal_loss(x, y, 2.0, (y + 1) / 10, ignore=3).alias("loss"))


def shifted_sql(shift: str, extra: str = "") -> str:
    """Cross entropy of every model after adding ``shift`` to every score."""
    return f"""WITH n AS (SELECT label AS k, count(*) AS n, count(*) / (sum(count(*)) OVER ()) AS prior FROM embeddings GROUP BY 1),
    z AS (SELECT id * 3 + m AS id, y, l.k, x + {shift} AS x FROM logit_cells l JOIN n USING (k)), e AS (SELECT *, max(x) OVER (PARTITION BY id) AS m0 FROM z)
    SELECT id, {r6('max(m0) + ln(sum(exp(x - m0))) - max(x) FILTER (k = y)', 'loss')} FROM e GROUP BY id"""


def class_sizes(spark, sf):
    rows = v.table(spark, sf, "embeddings").select("label")
    return encode.class_priors(rows, rows.distinct())


@check("f23_balanced_softmax_loss", "logit_cells", shifted_sql("ln(greatest(n, 1))"))
def _(spark, sf):
    counts = encode.class_array(class_sizes(spark, sf), "n", "label")
    rows = all_models(spark, sf).withColumn("c", counts)
    return rows.select("id", L.balanced_softmax_loss(F.col("x"), F.col("y"), F.col("c")).alias("loss"))


@check("f24_logit_adjusted_loss", "logit_cells", shifted_sql("0.7 * ln(greatest(prior, 1e-12))"))
def _(spark, sf):
    priors = encode.class_array(class_sizes(spark, sf), "prior", "label")
    rows = all_models(spark, sf).withColumn("c", priors)
    return rows.select("id", L.logit_adjusted_loss(F.col("x"), F.col("y"), F.col("c"), 0.7).alias("loss"))


@check(
    "f25_distill_loss",
    "logit_cells",
    f"""WITH z AS (SELECT id, y, k, max(x) FILTER (m = 0) AS s, avg(x) FILTER (m > 0) AS t FROM logit_cells GROUP BY ALL),
    e AS (SELECT *, s - ln(sum(exp(s)) OVER w) AS ls, s / 2 - ln(sum(exp(s / 2)) OVER w) AS ls2, t / 2 - ln(sum(exp(t / 2)) OVER w) AS lt2 FROM z WINDOW w AS (PARTITION BY id))
    SELECT id, {r6('0.3 * -max(ls) FILTER (k = y) + 0.7 * 4 * sum(exp(lt2) * (lt2 - ls2))', 'loss')} FROM e GROUP BY id""",
)
def _(spark, sf):
    teacher = ensemble.mean_teacher(v.logits(spark, sf).where("model <> 'm0'")).withColumnRenamed("logits", "t")
    rows = first_model(spark, sf).join(teacher, "id")
    return rows.select("id", L.distill_loss(F.col("x"), F.col("t"), F.col("y"), 0.3, 2.0).alias("loss"))


@check("f26_multitask_loss", "logit_cells", f"WITH {SM} SELECT id, {r6('-lp + 0.4 * -lp * lp', 'loss')} FROM sm WHERE k = y")
def _(spark, sf):
    main = L.cross_entropy(F.col("x"), F.col("y"))
    return all_models(spark, sf).select("id", L.multitask_loss(main, -main * main, 0.4).alias("loss"))


@check(
    "f27_constrained_logits",
    "logit_cells",
    f"""WITH tr AS (SELECT label, (label + vec_id % 2) % 3 AS g FROM embeddings WHERE label <> 7), n AS (SELECT c.label, gg.g, count(tr.g) AS n
      FROM (SELECT DISTINCT label FROM embeddings) c CROSS JOIN (SELECT unnest(range(0, 3)) AS g) gg LEFT JOIN tr ON tr.label = c.label AND tr.g = gg.g GROUP BY ALL),
    share AS (SELECT label AS k, g, CASE WHEN sum(n) OVER (PARTITION BY label) > 0 THEN n / (sum(n) OVER (PARTITION BY label)) ELSE 1 / 3 END AS s FROM n),
    gx AS (SELECT id, k % 3 AS g, sum(x ORDER BY k) AS x FROM logit_cells WHERE m = 1 GROUP BY ALL),
    gp AS (SELECT id, g, exp(x) / (sum(exp(x)) OVER (PARTITION BY id)) AS p FROM gx)
    SELECT id, k, {r6('any_value(x) + 0.5 * ln(greatest(sum(p * s), 1e-6))', 'x')} FROM logit_cells JOIN share USING (k) JOIN gp USING (id, g) WHERE m = 0 GROUP BY id, k""",
)
def _(spark, sf):
    rows = v.table(spark, sf, "embeddings").select(F.col("label").alias("label_id"), ((F.col("label") + F.col("vec_id") % 2) % 3).alias("group_id"))
    table = encode.class_group_compat(rows.where("label_id <> 7"), rows.select("label_id").distinct(), rows.select("group_id").distinct())
    group = v.logits(spark, sf).where("model = 'm1'").select("id", F.array(*[sum((F.get("logits", F.lit(k)) for k in range(g + 3, 10, 3)), F.get("logits", F.lit(g))) for g in range(3)]).alias("g"))
    both = first_model(spark, sf).join(group, "id").withColumn("c", encode.compat_array(table))
    out = both.select("id", L.constrained_logits(F.col("x"), F.col("g"), F.col("c"), 0.5).alias("x"))
    return out.select("id", F.posexplode("x").alias("k", "x"))


FEATURES = [f"e{i}" for i in range(64)]


def feature_rows(spark, sf):
    vec = [F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(64)]
    return v.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("parcel_id"), F.col("label").alias("label_id"), *vec)


def held_out(spark, sf):
    """Vectors with a stratified fifth held out for testing, and a fifth of the rest for validation."""
    rows = splits.stratified_split(feature_rows(spark, sf), "label_id", 0.2, 42)
    return rows.withColumn("validation", (F.col("split") == "train") & (F.pmod(F.xxhash64("parcel_id"), F.lit(5)) == 0))


@check("m1_random_forest")
def _(spark, sf):
    """The published 300 trees of depth 20; predictions for the rows held out."""
    rows = held_out(spark, sf)
    model = models.fit_random_forest(rows.where("split = 'train'"), FEATURES)
    return model.transform(rows.where("split = 'test'")).select("parcel_id", "label_id", "prediction")


@check("m2_boosted_trees")
def _(spark, sf):
    rows = held_out(spark, sf)
    model = models.fit_boosted_trees(rows.where("split = 'train'"), FEATURES, validation="validation", n_rounds=20, depth=3, patience=3)
    return model.transform(rows.where("split = 'test'")).select("parcel_id", "label_id", "prediction")


@check("m4_cv_macro_f1")
def _(spark, sf):
    return models.cv_macro_f1(feature_rows(spark, sf), FEATURES, models.fit_random_forest, k=3)


@check("m3_random_search")
def _(spark, sf):
    grid = {"trees": [10, 20, 40], "depth": [5, 10, 20], "min_rows": [1, 2, 4]}
    return models.random_search(feature_rows(spark, sf), FEATURES, models.fit_random_forest, grid, n=10, k=3)[2]


@check(
    "m3_search_draws",
    "",
    """WITH d AS (SELECT i AS id, row_number() OVER (ORDER BY md5(i || '|42'), i) - 1 AS trial FROM range(0, 4 * 4 * 4 * 4 * 4 * 4 * 4) AS r(i)),
    k AS (SELECT (count(*) // 50)::BIGINT AS n FROM embeddings)
    SELECT trial::INTEGER AS trial, id, concat('depth=', [4, 6, 8, 10][id // 4096 % 4 + 1], ', feature_share=', [0.6, 0.7, 0.8, 1.0][id // 1024 % 4 + 1], ', min_gain=', [0.0, 0.1, 0.2, 0.5][id // 256 % 4 + 1],
      ', min_rows=', [1, 2, 4, 6][id // 64 % 4 + 1], ', n_rounds=', [300, 500, 700, 900][id // 16 % 4 + 1], ', row_share=', [0.6, 0.7, 0.8, 1.0][id // 4 % 4 + 1], ', step=', [0.02, 0.03, 0.05, 0.08][id % 4 + 1]) AS params
    FROM d WHERE trial < (SELECT n FROM k)""",
)
def _(spark, sf):
    """A draw for each fifty rows of the table."""
    return models.search_draws(spark, models.BOOSTING_GRID, v.table(spark, sf, "embeddings").count() // 50).drop("digits")


@check("m5_feature_importance")
def _(spark, sf):
    rows = feature_rows(spark, sf)
    model = models.fit_random_forest(rows, FEATURES)
    return models.feature_importance(model, FEATURES, spark)


def tree_sql(depth: int, min_rows: int) -> str:
    """Levels of a tree by plain counting: for every node, feature and value, the class counts up to it."""
    out = ["cells AS (SELECT vec_id, label AS y, f, embedding[f + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS f))", "n0 AS (SELECT vec_id, label AS y, 1::BIGINT AS node FROM embeddings)"]
    for level in range(depth + 1):
        n = f"n{level}"
        out.append(f"sizes{level} AS (SELECT node, sum(c)::BIGINT AS n, arg_max(y, c * 1000 - y) AS prediction FROM (SELECT node, y, count(*) AS c FROM {n} GROUP BY ALL) GROUP BY node)")
        if level == depth:
            out.append(f"b{level} AS (SELECT NULL::BIGINT AS node, NULL::BIGINT AS f, NULL::DOUBLE AS threshold, NULL::DOUBLE AS gain WHERE false)")
            break
        out.append(
            f"""g{level} AS (SELECT a.node, a.f, a.v, k.y, (SELECT 0) + count(b.vec_id) AS c FROM (SELECT DISTINCT node, f, v FROM cells JOIN {n} USING (vec_id, y)) a CROSS JOIN (SELECT DISTINCT label AS y FROM embeddings) k
      LEFT JOIN (SELECT node, f, v, y, vec_id FROM cells JOIN {n} USING (vec_id, y)) b ON b.node = a.node AND b.f = a.f AND b.v = a.v AND b.y = k.y GROUP BY ALL),
    s{level} AS (SELECT node, f, v, y, sum(c) OVER (PARTITION BY node, f, y ORDER BY v) AS l, sum(c) OVER (PARTITION BY node, f, y) AS t FROM g{level}),
    u{level} AS (SELECT node, f, v, lead(v) OVER (PARTITION BY node, f ORDER BY v) AS next, sum(l) AS nl, sum(t) AS n, sum(l * l)::DOUBLE AS ll, sum((t - l) * (t - l))::DOUBLE AS rr, sum(t * t)::DOUBLE AS tt FROM s{level} GROUP BY node, f, v),
    x{level} AS (SELECT node, f, (v + next) / 2 AS threshold, round((1 - tt / (n * n)) - nl / n * (1 - ll / (nl * nl)) - (n - nl) / n * (1 - rr / ((n - nl) * (n - nl))), 10) AS gain
      FROM u{level} WHERE next IS NOT NULL AND nl >= {min_rows} AND n - nl >= {min_rows}),
    b{level} AS (SELECT node, f, threshold, gain FROM x{level} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, threshold) = 1),
    n{level + 1} AS (SELECT c.vec_id, c.y, b.node * 2 + (c.v > b.threshold)::INT AS node FROM {n} JOIN b{level} b USING (node) JOIN cells c ON c.vec_id = {n}.vec_id AND c.f = b.f)"""
        )
    nodes = " UNION ALL ".join(f"SELECT node, {i} AS depth, n, CASE WHEN f IS NULL THEN NULL ELSE 'e' || f END AS feature, threshold, coalesce(gain, 0) AS gain, prediction::VARCHAR AS prediction FROM sizes{i} LEFT JOIN b{i} USING (node)" for i in range(depth + 1))
    return f"WITH {', '.join(out)}, nodes AS ({nodes})"


@check("m1_exact_tree", "", f"{tree_sql(3, 2)} SELECT node, depth, n, feature, {r6('threshold', 'threshold')}, {r6('gain', 'gain')}, prediction FROM nodes")
def _(spark, sf):
    return fit_exact_tree(feature_rows(spark, sf), FEATURES, depth=3).table(spark)


@check(
    "m5_exact_importance",
    "",
    f"""{tree_sql(2, 5)} SELECT 'e' || f AS feature, {r6('coalesce(sum(n * gain), 0) / (SELECT sum(n * gain) FROM nodes)', 'importance')} FROM (SELECT unnest(range(0, 64)) AS f) LEFT JOIN nodes ON feature = 'e' || f GROUP BY f""",
)
def _(spark, sf):
    return models.feature_importance(fit_exact_tree(feature_rows(spark, sf), FEATURES, depth=2, min_rows=5), FEATURES, spark)


def vectors(spark, sf):
    vec = F.transform("embedding", lambda x: x.cast("double"))
    return v.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("parcel_id"), F.col("label").alias("label"), vec.alias("vec"))


PAIRS = """pts AS (SELECT vec_id::VARCHAR AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
    near AS (SELECT a.id AS parcel_id, b.id AS neighbour, a.label AS la, b.label AS lb, list_distance(a.e, b.e) AS d,
      row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.e, b.e), b.id) AS rank FROM pts a JOIN pts b ON a.id <> b.id {on})"""


@check(
    "x13_class_neighbours",
    "",
    f"WITH {PAIRS.format(on='AND a.label = b.label')} SELECT parcel_id, neighbour, {r6('d', 'distance')}, rank FROM near WHERE rank <= 5",
)
def _(spark, sf):
    rows = vectors(spark, sf)
    return nearest_neighbours(rows, rows, 5, "label")


SHORT = """short AS (SELECT label, n, (SELECT max(n) FROM c) - n AS need FROM c WHERE n < (SELECT max(n) FROM c))"""


@check(
    "x14_danger_rows",
    "",
    f"""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), {SHORT}, {PAIRS.format(on='')},
    f AS (SELECT parcel_id, any_value(la) AS label, count(*) FILTER (la <> lb) AS f FROM near WHERE rank <= 10 GROUP BY 1)
    SELECT parcel_id, label FROM f JOIN short USING (label) WHERE f >= 5 AND f < 10""",
)
def _(spark, sf):
    rows = vectors(spark, sf)
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    short = rows.join(sizes, "label").where(F.col("n") < sizes.agg(F.max("n")).scalar()).drop("n")
    return oversample.danger_rows(rows, short).select("parcel_id", "label")


@check("x13_smote_counts", "", "SELECT label AS label_id, (SELECT max(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)) AS n FROM embeddings GROUP BY 1")
def _(spark, sf):
    out = oversample.smote(feature_rows(spark, sf), FEATURES, label="label_id")
    return out.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"))


UNIT = "(('0x' || substr(md5(draw || '|42{s}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@check(
    "x13_synthetic_rows",
    "",
    f"""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), {SHORT}, {PAIRS.format(on='AND a.label = b.label')},
    hi AS (SELECT *, sum(need) OVER (ORDER BY label) AS hi FROM short),
    d AS (SELECT draw, arg_min(label, hi) AS label, arg_min(n, hi) AS n FROM range(0, (SELECT sum(need)::BIGINT FROM short)) AS r(draw) JOIN hi ON hi > draw GROUP BY 1),
    rk AS (SELECT id, label, e, row_number() OVER (PARTITION BY label ORDER BY md5(id || '|42'), id) AS rank FROM pts),
    s AS (SELECT draw, label, floor({UNIT.format(s='r')} * n) + 1 AS rank, floor({UNIT.format(s='n')} * 5) + 1 AS slot, {UNIT.format(s='g')} AS gap FROM d)
    SELECT 'synthetic-' || draw AS parcel_id, s.label, rk.id AS base, near.neighbour, {r6('gap', 'gap')}, {r6('rk.e[1] + gap * (o.e[1] - rk.e[1])', 'first')},
    {r6('rk.e[64] + gap * (o.e[64] - rk.e[64])', 'last')}
    FROM s JOIN rk ON rk.label = s.label AND rk.rank = s.rank JOIN near ON near.parcel_id = rk.id AND near.rank = s.slot JOIN pts o ON o.id = near.neighbour""",
)
def _(spark, sf):
    out = oversample.synthetic_rows(vectors(spark, sf))
    return out.select("parcel_id", "label", "base", "neighbour", "gap", F.get("vec", F.lit(0)).alias("first"), F.get("vec", F.lit(63)).alias("last"))


@check(
    "x14_borderline_smote",
    "",
    f"""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), {SHORT}, {PAIRS.format(on='')},
    f AS (SELECT parcel_id, any_value(la) AS label, count(*) FILTER (la <> lb) AS f FROM near WHERE rank <= 10 GROUP BY 1),
    danger AS (SELECT DISTINCT label FROM f WHERE f >= 5 AND f < 10)
    SELECT c.label AS label_id, CASE WHEN c.label IN (SELECT label FROM danger) THEN (SELECT max(n) FROM c) ELSE n END AS n FROM c""",
)
def _(spark, sf):
    out = oversample.borderline_smote(feature_rows(spark, sf), FEATURES, label="label_id")
    return out.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"))
