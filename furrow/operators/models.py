"""Tree classifiers on ``pyspark.ml``."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.functions.draws import draw_key
from furrow.functions.logits import argmax
from furrow.operators.encode import balanced_weight
from furrow.operators.evaluate import scalar_metrics
from furrow.operators.exact_tree import ExactTree
from furrow.operators.forest import Forest, Training, fit_forest
from furrow.operators.splits import stratified_kfold
from furrow.session import cut_lineage, discard

# The search space of the boosted model that has a Spark counterpart.
BOOSTING_GRID = {
    "n_rounds": [300, 500, 700, 900],
    "step": [0.02, 0.03, 0.05, 0.08],
    "depth": [4, 6, 8, 10],
    "min_rows": [1, 2, 4, 6],
    "row_share": [0.6, 0.7, 0.8, 1.0],
    "feature_share": [0.6, 0.7, 0.8, 1.0],
    "min_gain": [0.0, 0.1, 0.2, 0.5],
}


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")


def fit_random_forest(train: DataFrame | Training, features: Sequence[str], label: str = "label_id", trees: int = 300, depth: int = 20, min_rows: int = 2, seed: int = 42) -> Forest:
    """Random forest with balanced class weights.

    ``RandomForestClassifier`` sums a dense table of classes and bins for each node down to the last pair of rows, 20 KB for each of 1.2 million nodes (3,700 to 4,100 a tree)
    with 300 trees on 8,200 rows; see ``forest`` for the way taken here.
    """
    return fit_forest(train, features, label, trees, depth, min_rows, seed)


class BoostedTrees:
    """One boosted binary model per class; the class with the highest score wins.

    A loop of ``GBTClassifier`` rather than ``OneVsRest``, which drops the validation column that
    early stopping needs.
    """

    def __init__(self, models: dict[int, object], features: Sequence[str], rounds: dict[int, int] | None = None):
        self.models, self.features = models, list(features)
        #: Rounds kept of each class.
        self.rounds = rounds or {c: m.getNumTrees for c, m in models.items()}

    def transform(self, df: DataFrame) -> DataFrame:
        out = assembler(self.features).transform(df)
        kept = list(out.columns)
        scores = []
        for c, model in sorted(self.models.items()):
            named = model.copy().setRawPredictionCol(f"_raw{c}").setPredictionCol(f"_p{c}").setProbabilityCol(f"_q{c}")
            out = named.transform(out)
            scores.append(F.get(vector_to_array(f"_raw{c}"), F.lit(1)))
        ids = F.array(*[F.lit(c) for c in sorted(self.models)])
        out = out.select(*kept, F.array(*scores).alias("scores"))
        return out.withColumn("prediction", F.get(ids, argmax(F.col("scores"))).cast("double")).drop("features")

    def importances(self) -> dict[str, float]:
        vectors = [m.featureImportances.toArray() for m in self.models.values()]
        mean = sum(vectors) / len(vectors)
        total = mean.sum() or 1.0
        return {f: float(v / total) for f, v in zip(self.features, mean)}


def best_round(losses: Sequence[float], patience: int) -> tuple[int, bool]:
    """The round (from 1) with the least loss seen before ``patience`` rounds in a row brought nothing better, and whether they did.

    Of equal losses the first counts.
    """
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


def with_patience(fit: Callable[[int], object], losses: Callable[[object], Sequence[float]], n_rounds: int, patience: int):
    """The model with the best number of rounds, at most ``n_rounds``.

    ``fit(n)`` gives n rounds, of which the first m are those that ``fit(m)`` gives; ``losses`` scores every prefix of a model in one
    pass. The ensemble is grown to twice its size until patience runs out, so it costs at most four times the rounds
    that were looked at, and the kept one is fitted with exactly the best number of rounds.
    """
    rounds = min(n_rounds, 2 * patience)
    while True:
        model = fit(rounds)
        best, ended = best_round(losses(model), patience)
        if ended or rounds == n_rounds:
            return (model if best == rounds else fit(best)), best
        rounds = min(n_rounds, 2 * rounds)


def fit_boosted_trees(train: DataFrame, features: Sequence[str], label: str = "label_id", validation: str | None = None, n_rounds: int = 600, step: float = 0.05, depth: int = 6, min_rows: int = 1, row_share: float = 0.8, feature_share: float = 0.8, min_gain: float = 0.0, seed: int = 42, parallelism: int = 4, patience: int = 50) -> BoostedTrees:
    """Boosted trees with balanced weights; ``validation`` names a boolean column for early stopping.

    With it, rows it marks don't take part in the fit. Each class keeps the rounds up to its least loss on them, looked for until
    ``patience`` rounds in a row are no better. ``parallelism`` classes are fitted at a time, so that small stages of one fill the
    cluster's gaps left by another.
    """
    held = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    weighted = balanced_weight(train.where(~held), label)
    classes = sorted(r[0] for r in train.select(label).distinct().collect())
    rows = cut_lineage(assembler(features).transform(weighted).select("features", "weight", label))
    checked = cut_lineage(assembler(features).transform(train.where(held)).select("features", F.lit(1.0).alias("weight"), label)) if validation else None

    def fit_class(c: int) -> tuple[object, int]:
        own = rows.withColumn("_y", (F.col(label) == c).cast("double"))

        def fit(rounds: int):
            return GBTClassifier(
                featuresCol="features",
                labelCol="_y",
                weightCol="weight",
                maxIter=rounds,
                stepSize=step,
                maxDepth=depth,
                minInstancesPerNode=min_rows,
                subsamplingRate=row_share,
                featureSubsetStrategy=str(feature_share),
                minInfoGain=min_gain,
                seed=seed,
            ).fit(own)

        if checked is None:
            return fit(n_rounds), n_rounds
        marked = checked.withColumn("_y", (F.col(label) == c).cast("double"))
        return with_patience(fit, lambda model: model.evaluateEachIteration(marked), n_rounds, patience)

    with ThreadPoolExecutor(parallelism) as pool:
        found = dict(zip(classes, pool.map(fit_class, classes), strict=True))
    discard(rows, *([checked] if validation else []))
    return BoostedTrees({c: m for c, (m, _) in found.items()}, features, {c: r for c, (_, r) in found.items()})


def macro_f1(predicted: DataFrame, label: str = "label_id") -> float:
    scored = predicted.select(F.col(label).cast("double").alias("y_true"), F.col("prediction").cast("double").alias("y_pred"))
    return scalar_metrics(scored).first()["f1_macro"]


def _fold_scores(folds: DataFrame, features: Sequence[str], fit, settings: Sequence[dict], k: int, label: str, parallelism: int) -> list[tuple[int, int, float]]:
    """(setting, fold, macro-F1) of every setting on every fold of the stored table ``folds``, so many at a time.

    Forests are fitted on a fold's rows as bins, which are made once for all settings.
    """

    def training(fold: int) -> DataFrame | Training:
        rows = folds.where(F.col("fold") != fold).drop("fold")
        return Training(rows, features, label) if fit is fit_random_forest else rows

    def score(job: tuple[int, int]) -> tuple[int, int, float]:
        trial, fold = job
        model = fit(trained[fold], features, label=label, **settings[trial])
        return trial, fold, macro_f1(model.transform(folds.where(F.col("fold") == fold)), label)

    with ThreadPoolExecutor(parallelism) as pool:
        trained = list(pool.map(training, range(k)))
        scores = list(pool.map(score, [(trial, fold) for trial in range(len(settings)) for fold in range(k)]))
    for rows in trained:
        if isinstance(rows, Training):
            rows.close()
    return scores


def cv_macro_f1(train: DataFrame, features: Sequence[str], fit, k: int = 3, seed: int = 42, label: str = "label_id", key: str = "parcel_id", parallelism: int = 4, **params) -> DataFrame:
    """Macro-F1 of ``fit(rows, features, label=..., **params)`` per stratified fold."""
    folds = cut_lineage(stratified_kfold(train, label, k, seed, key))
    scores = [(fold, score) for _, fold, score in _fold_scores(folds, features, fit, [params], k, label, parallelism)]
    discard(folds)
    return train.sparkSession.createDataFrame(scores, "fold int, score double")


def search_draws(spark, grid: dict[str, list], n: int, seed: int = 42) -> DataFrame:
    """n different settings of the grid: (trial, id, params). Settings are numbered, and those with the smallest hashes are drawn.

    The last of the names in order turns fastest. With fewer settings than n, all are drawn.
    """
    names = sorted(grid)
    sizes = [len(grid[name]) for name in names]
    drawn = spark.range(math.prod(sizes)).withColumn("h", draw_key(seed, "id")).orderBy("h", "id").limit(n).collect()  # n rows
    rows = []
    for trial, r in enumerate(drawn):
        rest, at = r["id"], []
        for size in reversed(sizes):
            rest, digit = divmod(rest, size)
            at.append(digit)
        rows.append((trial, r["id"], ", ".join(f"{name}={grid[name][d]}" for name, d in zip(names, reversed(at), strict=True)), list(reversed(at))))
    return spark.createDataFrame(rows, "trial int, id long, params string, digits array<int>")


def random_search(train: DataFrame, features: Sequence[str], fit, grid: dict[str, list] = BOOSTING_GRID, n: int = 10, k: int = 3, seed: int = 42, label: str = "label_id", key: str = "parcel_id", parallelism: int = 4, **fixed):
    """n different random settings scored by cross-validated macro-F1.

    All trials use one stored table of folds, ``parallelism`` fits at a time. Returns the model refit with the best setting (the
    first of equals), that setting, and a table of all trials.
    """
    names = sorted(grid)
    draws = search_draws(train.sparkSession, grid, n, seed).orderBy("trial").collect()  # n rows
    settings = [{name: grid[name][d] for name, d in zip(names, r["digits"], strict=True)} for r in draws]
    folds = cut_lineage(stratified_kfold(train, label, k, seed, key))
    scores = _fold_scores(folds, features, fit, [s | fixed for s in settings], k, label, parallelism)
    discard(folds)
    table = train.sparkSession.createDataFrame([(t, draws[t]["params"], f, s) for t, f, s in scores], "trial int, params string, fold int, score double")
    trials = table.groupBy("trial", "params").agg(F.avg("score").alias("score_mean"), F.stddev_pop("score").alias("score_std")).orderBy("trial")
    best = max(range(len(settings)), key=lambda t: (sum(s for u, _, s in scores if u == t), -t))
    return fit(train, features, label=label, **settings[best], **fixed), settings[best], trials


def feature_importance(model, features: Sequence[str], spark) -> DataFrame:
    """Importance per feature name; one row per feature, summing to 1."""
    if isinstance(model, (BoostedTrees, ExactTree, Forest)):
        pairs = list(model.importances().items())
    else:
        pairs = [(f, float(v)) for f, v in zip(features, model.stages[-1].featureImportances.toArray())]
    return spark.createDataFrame(pairs, "feature string, importance double").orderBy(F.desc("importance"), "feature")
