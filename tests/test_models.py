"""Exact trees, early stopping, settings and folds against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import exact_tree, models
from furrow.operators.splits import stratified_kfold


def plain_tree(x, y, classes, depth, min_rows, node=1):
    """(node, n, feature, threshold) of a tree grown by trying every cut."""

    def gini(labels):
        return 1 - sum((labels.count(c) / len(labels)) ** 2 for c in classes)

    best = None
    if depth and len(set(y)) > 1:
        for f in range(x.shape[1]):
            known = [i for i in range(len(y)) if not math.isnan(x[i, f])]
            values = sorted({x[i, f] for i in known})
            for a, b in zip(values, values[1:]):
                cut = (a + b) / 2
                left, right = [y[i] for i in known if x[i, f] <= cut], [y[i] for i in known if x[i, f] > cut]
                n = len(known)
                gain = round(gini(left + right) - len(left) / n * gini(left) - len(right) / n * gini(right), 10)
                if min(len(left), len(right)) >= min_rows and gain > 0 and (best is None or (gain, -f, -cut) > best[0]):
                    best = ((gain, -f, -cut), f, cut)
    if best is None:
        return [(node, len(y), None, None)]
    goes = [not x[i, best[1]] > best[2] for i in range(len(y))]
    part = lambda side: (x[[g == side for g in goes]], [v for v, g in zip(y, goes) if g == side])
    return [(node, len(y), f"f{best[1]}", best[2]), *plain_tree(*part(True), classes, depth - 1, min_rows, 2 * node), *plain_tree(*part(False), classes, depth - 1, min_rows, 2 * node + 1)]


@pytest.mark.parametrize("ranges", [2, 64])
def test_exact_tree_equals_trying_every_cut(spark, monkeypatch, ranges):
    monkeypatch.setattr(exact_tree, "RANGES", ranges)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(90, 3)), 1)  # many equal values
    x[rng.random(x.shape) < 0.1] = math.nan
    y = [["a", "b", "c"][int(v)] for v in np.clip(np.nan_to_num(x[:, 0]) + rng.normal(size=90) * 0.7 + 1, 0, 2)]
    rows = [(str(i), y[i], *[None if math.isnan(v) and i % 2 else float(v) for v in x[i]]) for i in range(90)]
    df = spark.createDataFrame([*rows, ("no", None, 1.0, 1.0, 1.0)], "parcel_id string, label_id string, f0 double, f1 double, f2 double")
    tree = exact_tree.fit_exact_tree(df, ["f0", "f1", "f2"], depth=3, min_rows=3)
    want = plain_tree(x, y, ["a", "b", "c"], 3, 3)
    assert [(n.node, n.n, n.feature) for n in tree.nodes] == sorted((n, k, f) for n, k, f, _ in want)
    assert [n.threshold for n in tree.nodes if n.feature] == pytest.approx([t for _, _, f, t in sorted(want, key=lambda w: w[0]) if f])
    leaves = tree.transform(df.where("label_id is not null")).groupBy("leaf").count().collect()
    assert {r["leaf"]: r["count"] for r in leaves} == {n.node: n.n for n in tree.nodes if n.feature is None}
    assert sum(tree.importances().values()) == pytest.approx(1.0)


def test_exact_tree_over_many_ranges_and_copies(spark, monkeypatch):
    """Ranges of a few rows, half of the rows copies of one, a column with a dot in its name."""
    monkeypatch.setattr(exact_tree, "RANGE_ROWS", 6)
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(120, 2)), 1)
    x[::2] = [0.0, -0.0]
    y = ["ab"[int(v + rng.normal() * 0.4 > 0.1)] for v in x[:, 1]]
    df = spark.createDataFrame([(str(i), y[i], *map(float, x[i])) for i in range(120)], "parcel_id string, label_id string, `f.0` double, f1 double").repartition(5)
    tree = exact_tree.fit_exact_tree(df, ["f.0", "f1"], depth=4, min_rows=2)
    want = [(n, k, f and {"f0": "f.0"}.get(f, f)) for n, k, f, _ in plain_tree(x, y, ["a", "b"], 4, 2)]
    assert [(n.node, n.n, n.feature) for n in tree.nodes] == sorted(want, key=lambda w: w[0])
    leaves = tree.transform(df).groupBy("leaf").count().collect()
    assert {r["leaf"]: r["count"] for r in leaves} == {n.node: n.n for n in tree.nodes if n.feature is None}


def test_exact_tree_without_a_cut(spark):
    same = spark.createDataFrame([("1", 0, 1.0), ("2", 1, 1.0), ("3", 1, None)], "parcel_id string, label_id int, x double")
    tree = exact_tree.fit_exact_tree(same, ["x"])
    assert [(n.node, n.n, n.prediction, n.feature) for n in tree.nodes] == [(1, 3, 1, None)]
    assert tree.importances() == {"x": 0.0}
    assert {r["prediction"] for r in tree.transform(same).collect()} == {1}
    with pytest.raises(ValueError):
        exact_tree.fit_exact_tree(same.limit(0), ["x"])


@pytest.mark.parametrize(
    ("losses", "patience", "best"),
    [([3, 2, 1, 2, 2, 2, 0], 3, (3, True)), ([3, 2, 1, 2, 2, 0, 1], 3, (6, False)), ([1, 1, 1, 1], 2, (1, True)), ([4, 3, 2], 2, (3, False)), ([1], 1, (1, False))],
)
def test_best_round(losses, patience, best):
    assert models.best_round(losses, patience) == best


def test_patience_grows_the_model_only_as_far_as_needed():
    curve = [abs(r - 17) for r in range(1, 101)]  # the best round is the 17th
    fitted = []
    model, best = models.with_patience(lambda n: fitted.append(n) or n, lambda n: curve[:n], 100, 5)
    assert (model, best) == (17, 17) and fitted == [10, 20, 40, 17]
    assert models.with_patience(lambda n: n, lambda n: curve[:n], 12, 5) == (12, 12)


def noisy(spark, n=240):
    """One telling and one empty feature; a fifth of the labels is wrong."""
    rng = np.random.default_rng(n)
    rows = [(str(i), int((i + (rng.random() < 0.2)) % 2), float(i % 2 + rng.random()), float(rng.random())) for i in range(n)]
    return spark.createDataFrame(rows, "parcel_id string, label_id int, a double, b double")


def test_boosting_keeps_the_best_validation_round(spark):
    rows = noisy(spark).withColumn("hold", F.col("parcel_id").cast("int") % 3 == 0)
    model = models.fit_boosted_trees(rows, ["a", "b"], validation="hold", n_rounds=12, step=0.5, depth=3, patience=3, row_share=1.0, feature_share=1.0)
    long = models.fit_boosted_trees(rows.where("not hold"), ["a", "b"], n_rounds=12, step=0.5, depth=3, row_share=1.0, feature_share=1.0)
    marked = models.assembler(["a", "b"]).transform(rows.where("hold")).withColumn("weight", F.lit(1.0))
    for c in (0, 1):
        losses = long.models[c].evaluateEachIteration(marked.withColumn("_y", (F.col("label_id") == c).cast("double")))
        assert model.rounds[c] == models.best_round(losses, 3)[0] == model.models[c].getNumTrees < 12


def test_search_equals_a_plain_loop(spark):
    """Exact trees: a forest's sums of weights meet in another order from run to run, and ties of its cuts fall otherwise."""
    rows = noisy(spark, 60)
    grid = {"min_rows": [1, 9], "depth": [1, 2]}
    model, best, table = models.random_search(rows, ["a", "b"], exact_tree.fit_exact_tree, grid, n=3, k=2)
    trials = table.collect()
    assert len({r["params"] for r in trials}) == 3
    folds = stratified_kfold(rows, "label_id", 2, 42).collect()
    for r in trials:
        params = {k: int(v) for k, v in (p.split("=") for p in r["params"].split(", "))}
        scores = []
        for fold in range(2):
            part = lambda inside: spark.createDataFrame([f for f in folds if (f["fold"] == fold) == inside])  # noqa: E731, B023
            scores.append(models.macro_f1(exact_tree.fit_exact_tree(part(False), ["a", "b"], **params).transform(part(True))))
        assert r["score_mean"] == pytest.approx(sum(scores) / 2)
    top = max(r["score_mean"] for r in trials)
    assert ", ".join(f"{k}={best[k]}" for k in sorted(best)) == next(r["params"] for r in trials if r["score_mean"] == top)
    assert max(n.depth for n in model.nodes) <= best["depth"]


def test_draws_are_different_settings(spark):
    grid = {"a": [1, 2, 3], "b": ["x", "y"]}
    assert sorted(r["params"] for r in models.search_draws(spark, grid, 99).collect()) == sorted(f"a={a}, b={b}" for a in grid["a"] for b in grid["b"])
    assert models.search_draws(spark, models.BOOSTING_GRID, 50).select("id").distinct().count() == 50
