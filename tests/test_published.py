"""Scores that must follow from published class totals."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from furrow.operators import evaluate, importance, reshape

# Class, support, hits and predictions of a published 25-class evaluation.
CLASSES = [
    ("AVH", 40, 15, 427),
    ("BDH", 367, 170, 259),
    ("BOR", 1688, 926, 3297),
    ("BTA", 134, 32, 685),
    ("BTH", 195, 60, 138),
    ("CEE", 103, 61, 439),
    ("JAC", 1341, 398, 1276),
    ("LUZ", 448, 109, 453),
    ("MDI", 40, 13, 824),
    ("MLC", 50, 15, 344),
    ("MLG", 108, 46, 377),
    ("MLO", 63, 56, 87),
    ("OLI", 379, 117, 1129),
    ("ORH", 174, 94, 268),
    ("PCH", 52, 36, 108),
    ("PPH", 1594, 335, 584),
    ("PTR", 634, 12, 64),
    ("SAI", 57, 30, 686),
    ("SIN", 54, 36, 2152),
    ("SNE", 1736, 20, 111),
    ("SOG", 64, 42, 286),
    ("SPH", 1033, 332, 978),
    ("SPL", 663, 168, 419),
    ("VRC", 11212, 6257, 6713),
    ("VRG", 172, 62, 297),
]
ACCURACY, MACRO_F1, WEIGHTED_F1 = 0.4214990402214187, 0.2632800875966831, 0.47628835003796355
MACRO_PRECISION, MACRO_RECALL, WEIGHTED_PRECISION = 0.27152003885398296, 0.40519362360442945, 0.624241056418731


def totals():
    return CLASSES


@pytest.fixture(scope="module")
def preds(spark):
    """Some predictions with these totals."""
    rows = totals()
    pairs = [(n, n, h) for n, _, h, _ in rows]
    missed = [n for n, s, h, _ in rows for _ in range(s - h)]
    false = [n for n, _, h, p in rows for _ in range(p - h)]
    # The first rotation of the false alarms that pairs no class with itself.
    for shift in range(0, len(false), 100):
        turned = false[shift:] + false[:shift]
        if all(t != p for t, p in zip(missed, turned)):
            break
    assert len(missed) == len(false) and all(t != p for t, p in zip(missed, turned))
    pairs += [(t, p, n) for (t, p), n in Counter(zip(missed, turned)).items()]
    table = spark.createDataFrame(pairs, "y_true string, y_pred string, n int").where("n > 0")
    return table.withColumn("_r", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("_r", "n")


def test_scalar_scores(preds):
    row = evaluate.scalar_metrics(preds).first()
    assert row["n"] == 22_401
    assert row["accuracy"] == pytest.approx(ACCURACY, abs=1e-12)
    assert row["f1_macro"] == pytest.approx(MACRO_F1, abs=1e-12)
    assert row["f1_weighted"] == pytest.approx(WEIGHTED_F1, abs=1e-12)


def test_class_report(spark, preds):
    names = spark.createDataFrame([(n,) for n, *_ in totals()], "label string")
    report = {r["name"]: r for r in evaluate.class_report(preds, names).collect()}
    assert report["macro avg"]["precision"] == pytest.approx(MACRO_PRECISION, abs=1e-12)
    assert report["macro avg"]["recall"] == pytest.approx(MACRO_RECALL, abs=1e-12)
    assert report["weighted avg"]["precision"] == pytest.approx(WEIGHTED_PRECISION, abs=1e-12)
    assert report["VRC"]["f1"] == pytest.approx(0.6981311018131102, abs=1e-12)
    assert report["PTR"]["recall"] == pytest.approx(0.01892744479495268, abs=1e-12)


def test_report_text(spark):
    preds = spark.createDataFrame([("AVH", "AVH")] * 2 + [("AVH", "VRC")] * 3 + [("VRC", "VRC")] * 5, "y_true string, y_pred string")
    names = preds.select(F.col("y_true").alias("label")).distinct()
    lines = [r["line"] for r in evaluate.report_text(evaluate.class_report(preds, names)).collect()]
    assert lines == [
        "              precision    recall  f1-score   support",
        "",
        "         AVH       1.00      0.40      0.57         5",
        "         VRC       0.62      1.00      0.77         5",
        "",
        "    accuracy                           0.70        10",
        "   macro avg       0.81      0.70      0.67        10",
        "weighted avg       0.81      0.70      0.67        10",
    ]


def test_phases_follow_each_other(spark):
    h1 = spark.range(1, 34).select(F.col("id").cast("double").alias("epoch"), F.lit(0.1).alias("loss"))
    h2 = spark.range(1, 10).select(F.col("id").cast("double").alias("epoch"), F.lit(0.2).alias("loss"))
    rows = reshape.concat_history(h1, h2).collect()
    assert [r["epoch"] for r in rows] == [float(n) for n in range(1, 43)]
    assert rows[33]["loss"] == 0.2


def test_importance_parts(spark):
    imp = spark.createDataFrame(
        [("NDVI__2024-01-12", 0.5), ("NDVI__mean", 0.25), ("EVI__2024-01-12", 0.125), ("EVI__auc__x", 0.125)], "feature string, gain double"
    )
    by_date, by_index = importance.importance_by_date_and_index(imp)
    assert [(str(r["date"]), r["gain"]) for r in by_date.collect()] == [("2024-01-12", 0.625)]
    assert [(r["idx"], r["gain"]) for r in by_index.collect()] == [("NDVI", 0.75), ("EVI", 0.25)]
