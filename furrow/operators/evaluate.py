"""Evaluation of predictions. Everything derives from the (true, predicted) counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.session import small_side


def pair_counts(preds: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    return preds.groupBy(*by, F.col(y_true).alias("t"), F.col(y_pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def _per_class(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """True positives, support and predictions of every class that occurs on either side."""
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(zero)
    sides = F.array(
        F.struct(F.col("t").alias("label"), hit.alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col("p").alias("label"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")),
    )
    return (
        pairs.select(*by, F.explode(sides).alias("_s"))
        .groupBy(*by, F.col("_s.label").alias("label"))
        .agg(*[F.sum(f"_s.{c}").alias(c) for c in ("tp", "support", "predicted")])
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def _with_scores(classes: DataFrame) -> DataFrame:
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return classes.withColumns(
        {"precision": _ratio(tp, predicted), "recall": _ratio(tp, support), "f1": _ratio(2.0 * tp, support + predicted)}
    )


def scalar_metrics(preds: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """Scores averaged over the labels present in truth or prediction; one row per ``by``."""
    classes = _with_scores(_per_class(pair_counts(preds, y_true, y_pred, by), by))
    total, support = F.sum("support"), F.col("support")
    return classes.groupBy(*by).agg(
        total.alias("n"),
        (F.sum("tp") / total).alias("accuracy"),
        F.avg(F.when(support > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("recall") * support) / total).alias("recall_weighted"),
        (F.sum(F.col("f1") * support) / total).alias("f1_weighted"),
    )


def compare_splits(preds: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    return scalar_metrics(preds, y_true, y_pred, ["split"]).select(
        "split", "accuracy", "precision_macro", "recall_macro", "f1_weighted", "f1_macro"
    )


def confusion(preds: DataFrame, labels: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Counts over the full label grid as (t, p, n). ``labels`` is the class dictionary."""
    names = labels.agg(F.collect_set("label")).scalar()
    grid = labels.select(F.col("label").alias("t"), F.explode(names).alias("p"))
    cells = grid.join(small_side(pair_counts(preds, y_true, y_pred)), ["t", "p"], "left")
    return cells.select("t", "p", F.coalesce("n", F.lit(0)).alias("n"))


def confusion_wide(cm: DataFrame, labels: Sequence) -> DataFrame:
    return cm.groupBy("t").pivot("p", list(labels)).agg(F.sum("n")).orderBy("t")


def confusion_normalised(cm: DataFrame) -> DataFrame:
    """Shares of each true class; an empty row stays 0."""
    return cm.select("t", "p", _ratio(F.col("n"), F.sum("n").over(Window.partitionBy("t"))).alias("share"))


def class_report(preds: DataFrame, labels: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Scores per class of the dictionary, then accuracy and two averages over all of them.

    Columns ``kind`` (0 class, 1 accuracy, 2 macro, 3 weighted), ``name`` and the scores.
    """
    seen = small_side(_per_class(pair_counts(preds, y_true, y_pred)))
    full = labels.select("label").join(seen, "label", "left").fillna(0, ["tp", "support", "predicted"])
    classes = _with_scores(full)
    scores = ("precision", "recall", "f1")
    total, support = F.sum("support"), F.col("support")
    acc = F.sum("tp") / total
    rows = classes.agg(
        F.array(
            F.struct(F.lit(1).alias("kind"), F.lit("accuracy").alias("name"), *[acc.alias(s) for s in scores], total.alias("support")),
            F.struct(F.lit(2).alias("kind"), F.lit("macro avg").alias("name"), *[F.avg(s).alias(s) for s in scores], total.alias("support")),
            F.struct(
                F.lit(3).alias("kind"),
                F.lit("weighted avg").alias("name"),
                *[_ratio(F.sum(F.col(s) * support), total).alias(s) for s in scores],
                total.alias("support"),
            ),
        ).alias("_r")
    ).select(F.explode("_r").alias("_r")).select("_r.*")
    per = classes.select(F.lit(0).alias("kind"), F.col("label").cast("string").alias("name"), *scores, "support")
    return per.unionByName(rows)


def report_text(report: DataFrame, digits: int = 2) -> DataFrame:
    """The report as fixed-width text: ``pos`` and ``line``, in printing order."""
    width = report.agg(F.greatest(F.max(F.length("name")), F.lit(len("weighted avg")))).first()[0]
    cell, gap = f"%9.{digits}f", " " * 9
    # Halves round to even, as the usual text reports do.
    p, r, f = (F.bround(c, digits) for c in ("precision", "recall", "f1"))
    body = F.format_string(f"%{width}s  {cell} {cell} {cell} %9d", "name", p, r, f, "support")
    flat = F.format_string(f"%{width}s  {gap} {gap} {cell} %9d", "name", f, "support")
    lines = report.select(
        F.col("kind"), F.col("name"), F.when(F.col("kind") == 1, flat).otherwise(body).alias("line")
    )
    head = f"{'':>{width}s}  {'precision':>9} {'recall':>9} {'f1-score':>9} {'support':>9}"
    fixed = report.sparkSession.createDataFrame([(-2, "", head), (-1, "", ""), (1, "", "")], lines.schema)
    order = Window.orderBy("kind", "name")
    return lines.unionByName(fixed).select((F.row_number().over(order) - 1).alias("pos"), "line").orderBy("pos")


def error_analysis(cm: DataFrame) -> DataFrame:
    """Support, hits, misses and the most frequent wrong class (the first on ties), per class."""
    off = (F.col("t") != F.col("p")) & (F.col("n") > 0)
    worst = F.min(F.when(off, F.struct((-F.col("n")).alias("neg"), F.col("p").alias("p"))))
    hit = F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0))
    return (
        cm.groupBy("t")
        .agg(F.sum("n").alias("support"), hit.alias("true_positive"), worst.alias("_w"))
        .select(
            F.col("t").alias("class_name"),
            "support",
            "true_positive",
            (F.col("support") - F.col("true_positive")).alias("false_negative"),
            F.col("_w.p").alias("main_confusion_target"),
            F.coalesce(-F.col("_w.neg"), F.lit(0)).alias("main_confusion_count"),
        )
    )


def decode_predictions(preds: DataFrame, labels: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Add the names of both class ids. ``labels`` has ``label_id`` and ``label``."""
    names = small_side(labels.select("label_id", "label"))
    truth = names.select(F.col("label_id").alias(y_true), F.col("label").alias("y_true_label"))
    guess = names.select(F.col("label_id").alias(y_pred), F.col("label").alias("y_pred_label"))
    return preds.join(truth, y_true, "left").join(guess, y_pred, "left")


def rank_runs(runs: DataFrame, score: str = "test_macro_f1", name: str = "run") -> DataFrame:
    """Best run first, equal ones by name; a run without a score ranks as -1."""
    return runs.orderBy(F.coalesce(F.col(score), F.lit(-1.0)).desc(), name)
