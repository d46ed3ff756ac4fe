"""The forest against a plain recursion, and its two ways of growing against each other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.operators import forest, models


def noisy(n, features=2, classes=3, seed=1):
    rng = np.random.default_rng(seed)
    codes = rng.integers(0, forest.BINS, (n, features)).astype(np.uint8)
    y = np.minimum(codes[:, 0] // 11, classes - 1).astype(int)
    wrong = rng.random(n) < 0.3
    y[wrong] = rng.integers(0, classes, wrong.sum())
    return codes, y, rng.integers(1, 4, n).astype(np.int32)


def plain(codes, y, times, weights, depth, min_rows):
    """Class shares that every row gets, by trying every cut of every feature."""

    def held(at):
        return np.array([times[at][y[at] == c].sum() for c in range(len(weights))])

    def score(at):
        w = held(at) * weights
        return (w * w).sum() / w.sum()

    out = np.zeros((len(y), len(weights)))

    def part(at, level):
        best = (0, None)
        if level < depth and (held(at) > 0).sum() > 1 and times[at].sum() >= 2 * min_rows:
            for f in range(codes.shape[1]):
                for b in range(forest.BINS):
                    left, right = at[codes[at, f] <= b], at[codes[at, f] > b]
                    if len(left) and len(right) and min(times[left].sum(), times[right].sum()) >= min_rows:
                        gain = (score(left) + score(right) - score(at)) / (held(at) * weights).sum()
                        if gain > best[0] + 1e-12:
                            best = (gain, (left, right))
        if best[1] is None:
            w = held(at) * weights
            out[at] = w / w.sum()
        else:
            part(best[1][0], level + 1), part(best[1][1], level + 1)

    part(np.arange(len(y)), 0)
    return out


@pytest.mark.parametrize(("depth", "min_rows"), [(20, 2), (3, 1), (6, 9), (0, 1)])
def test_a_subtree_equals_trying_every_cut(depth, min_rows):
    codes, y, times = noisy(160)  # the root of two features is both
    weights = np.array([1.0, 2.5, 0.7])
    tree, gains = forest.grow(codes, y, times, weights, 0, 1, depth, min_rows, 42)
    assert np.allclose(tree.shares(codes), plain(codes, y, times, weights, depth, min_rows))
    assert len(gains) == 2 and (gains.sum() > 0) == (depth > 0)


@pytest.mark.parametrize(("cells", "spread"), [(0, 0), (0, 5), (2, 5), (1_000_000, 0)])
def test_both_ways_to_find_cuts_equal_trying_every_cut(monkeypatch, cells, spread):
    """Also where class weights differ by many orders, and where features give equal cuts."""
    monkeypatch.setattr(forest, "CELLS_EACH", cells)
    codes, y, times = noisy(200)
    weights = 10.0 ** np.array([-spread, 0, spread])
    tree, gains = forest.grow(codes, y, times, weights, 0, 1, 20, 2, 42)
    assert np.allclose(tree.shares(codes), plain(codes, y, times, weights, 20, 2))
    # The first of equal cuts is taken.
    tree, gains = forest.grow(codes[:, [0, 0]], y, times, weights, 0, 1, 20, 2, 42)
    assert not tree.feature.any() and gains[0] > 0 == gains[1]


def test_class_counts_are_taken_for_few_cuts(monkeypatch):
    """Below the first levels, a node's class counts are taken for cuts that may be its best, not for all."""
    seen = []
    monkeypatch.setattr(forest, "_best", lambda left, *rest, real=forest._best: seen.append(len(left)) or real(left, *rest))
    codes, y, times = noisy(4000, features=16, classes=8)
    tree, _ = forest.grow(codes, y, times, np.ones(8), 0, 1, 20, 2, 42)
    assert (tree.child >= 0).sum() > 500 and sum(seen) < 4 * 4000


def rows_of(spark, n=400):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(n, 5)), 2)
    y = (x[:, 0] + x[:, 3] + rng.normal(size=n) * 0.5 > 0).astype(int) + 2 * (rng.random(n) < 0.1)
    return spark.createDataFrame([(f"{i:04d}", int(y[i]), *map(float, x[i])) for i in range(n)], "parcel_id string, label_id int, a double, b double, `c.d` double, e double, f double")


def test_large_and_small_nodes_grow_the_same_trees(spark, monkeypatch):
    rows, names = rows_of(spark), ["a", "b", "c.d", "e", "f"]
    got = []
    for local in (16_384, 25, 1):
        monkeypatch.setattr(forest, "LOCAL_ROWS", local)
        monkeypatch.setattr(forest, "NODES_TOGETHER", 3)
        model = models.fit_random_forest(rows, names, trees=7, depth=9)
        assert sum(len(t.cut) > 0 for t in model.tops) == (0 if local == 16_384 else 7)
        scored = model.transform(rows)
        assert scored.columns == [*rows.columns, "probability", "prediction"]
        got.append(({r["parcel_id"]: (r["prediction"], r["probability"]) for r in scored.collect()}, model.importances()))
        assert sum(model.importances().values()) == pytest.approx(1.0)
    first, importance = got[0]
    for other, same in got[1:]:
        assert same == pytest.approx(importance)
        assert all(other[k][1] == pytest.approx(p) for k, (_, p) in first.items())
    assert np.mean([first[r["parcel_id"]][0] == r["label_id"] for r in rows.collect()]) > 0.85


def test_no_group_holds_more_rows_than_allowed(spark, monkeypatch):
    """Also where copies can't be parted: half of the rows are one row with two labels."""
    monkeypatch.setattr(forest, "LOCAL_ROWS", 40)
    rows = spark.range(600).select(
        F.col("id").cast("string").alias("parcel_id"),
        F.floor(F.col("id") % 4 / 2).cast("int").alias("label_id"),
        F.when(F.col("id") % 2 == 0, F.lit(0.0)).otherwise(F.col("id") / 7.0).alias("a"),
        F.when(F.col("id") % 2 == 0, F.lit(0.0)).otherwise(F.col("id") % 13 / 1.0).alias("b"),
    )
    seen = []
    monkeypatch.setattr(forest, "_subtrees", lambda stored, tops, *rest, real=forest._subtrees: seen.append((stored.collect(), tops)) or real(stored, tops, *rest))
    model = models.fit_random_forest(rows, ["a", "b"], trees=3, depth=20)
    stored, tops = seen[0]
    codes = np.stack([np.frombuffer(r["codes"], np.uint8) for r in stored])
    for tree, top in enumerate(tops):
        times = forest._times(np.array([r["id"] for r in stored]), tree, 42)
        at = top.nodes(codes)
        small = [times[at == node].sum() for node in np.unique(at) if node not in top.leaf]
        assert max(small) <= 40 and top.leaf
    shares = [r["probability"] for r in model.transform(rows).where("a = 0").collect()]
    assert len(shares) == 300 and all(0.3 < s[0] < 0.7 for s in shares)


def test_missing_values_labels_and_few_rows(spark):
    rows = spark.createDataFrame([(str(i), None if i == 0 else i % 2, None if i % 4 == 1 else math.nan if i % 4 == 3 else 1.0 + i) for i in range(80)], "parcel_id string, label_id int, a double")
    model = models.fit_random_forest(rows, ["a"], trees=5, depth=3)
    got = {r["parcel_id"]: r["prediction"] for r in model.transform(rows).collect()}
    assert len(got) == 80 and all(got[str(i)] == i % 2 for i in range(80))  # odd rows lack the value
    one = models.fit_random_forest(rows.where("parcel_id = '1'"), ["a"], trees=2)
    assert {r["prediction"] for r in one.transform(rows).collect()} == {1.0}
    assert one.transform(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        models.fit_random_forest(rows.limit(0), ["a"])


def test_importance_and_folds_of_a_forest(spark):
    rows = rows_of(spark, 200)
    names = ["a", "b", "c.d", "e", "f"]
    table = models.feature_importance(models.fit_random_forest(rows, names, trees=20, depth=6), names, spark).collect()
    assert {r["feature"] for r in table[:2]} == {"a", "e"} and sum(r["importance"] for r in table) == pytest.approx(1.0)
    scores = models.cv_macro_f1(rows, names, models.fit_random_forest, k=3, trees=20, depth=6).collect()
    assert sorted(r["fold"] for r in scores) == [0, 1, 2] and all(r["score"] > 0.3 for r in scores)


def test_a_search_makes_the_bins_once_a_fold(spark, monkeypatch):
    rows, names = rows_of(spark, 200), ["a", "b", "c.d", "e", "f"]
    grid = {"trees": [3, 5], "depth": [2, 6]}
    made = []
    monkeypatch.setattr(forest, "_coded", lambda df, *rest, real=forest._coded: made.append("_row" not in df.columns) or real(df, *rest))
    _, _, trials = models.random_search(rows, names, models.fit_random_forest, grid, n=4, k=2)
    assert sum(made) == 2 + 1  # and once for the model of all rows
    got = {r["params"]: r["score_mean"] for r in trials.collect()}
    for params in ({"depth": 2, "trees": 3}, {"depth": 6, "trees": 5}):
        alone = models.cv_macro_f1(rows, names, models.fit_random_forest, k=2, **params).collect()
        assert got[", ".join(f"{k}={v}" for k, v in params.items())] == pytest.approx(np.mean([r["score"] for r in alone]))
