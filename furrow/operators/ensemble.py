"""Combination of the class scores of several models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.logits import argmax
from furrow.session import small_side


def check_label_lists(models: DataFrame) -> DataFrame:
    """Fail unless all models (``model``, ``label_names``) share one label list."""
    if models.select("label_names").distinct().limit(2).count() > 1:
        raise ValueError("the models were trained on different class lists")
    return models


def ensemble_weights(models: DataFrame, power: float = 1.0, uniform: bool = False) -> DataFrame:
    """Model weights from ``val_f1``, else ``best_metric``, else 0; uniform if all are 0."""
    if power <= 0:
        raise ValueError("power must be > 0")
    every = Window.partitionBy()

    def finite(c: str) -> Column:
        number = F.col(c)
        return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)

    score = F.greatest(F.coalesce(finite("val_f1"), finite("best_metric"), F.lit(0.0)), F.lit(0.0))
    raw = models.withColumn("score", F.lit(1.0) if uniform else score)
    mass = F.pow("score", F.lit(float(power)))
    even = 1.0 / F.count(F.lit(1)).over(every)
    total = F.sum(mass).over(every)
    return raw.select("model", "score", F.when(total > 0, mass / F.when(total > 0, total)).otherwise(even).alias("weight"))


def ensemble(scores: DataFrame, weights: DataFrame, key: str = "id") -> DataFrame:
    """Weighted sum of ``logits`` over the models of each row, and its argmax as ``y_pred``.

    ``scores`` has one row per (model, key). Rows meet once per key, with one array per model.
    """
    weighted = scores.join(small_side(weights.select("model", "weight")), "model")
    entry = F.struct("model", F.transform("logits", lambda v: v * F.col("weight")).alias("x"))
    parts = weighted.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_p"))
    first = F.get(F.col("_p"), F.lit(0))["x"]
    rest = F.slice("_p", 2, F.size("_p"))
    total = F.aggregate(rest, first, lambda acc, m: F.zip_with(acc, m["x"], lambda a, b: a + b))
    alike = F.forall(rest, lambda m: F.size(m["x"]) == F.size(first))
    total = F.when(alike, total).otherwise(F.raise_error(F.lit("the models have different numbers of classes")))
    return parts.select(key, total.alias("logits")).withColumn("y_pred", argmax(F.col("logits")))


def mean_teacher(scores: DataFrame, key: str = "id") -> DataFrame:
    """Plain mean of the teachers' logits per row."""
    models = scores.select("model").distinct().withColumn("weight", 1.0 / F.count(F.lit(1)).over(Window.partitionBy()))
    return ensemble(scores, models, key).drop("y_pred")
