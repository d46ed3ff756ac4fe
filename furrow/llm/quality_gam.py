"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins. Shallow trees on one feature at a time are boosted in turn, round after round, and each adds
to its feature's lookup table; then the pairs of features whose joint table explains most of what is left get trees
of their own. A score is the sum of table entries, looked up by bin for all rows at once.

The model is fitted on a bounded, hashed sample of labelled rows; features are taken from whole texts. The labels only serve
to fit; a score reads nothing but the text.

Null and empty texts have features of zero and a score like any other. Without labelled rows all scores are 0.5. Ties and
repeated rows get equal scores. Extra columns are not read. Rows that share an id share a label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import drawn_apart, by_text, shingle_hashes, stored, table, text_or_empty, word_hashes
from furrow.llm.pieces import grouped

SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAST_ROWS = 120, 40, 0.1, 5
FEATURES = (
    "words", "word_length", "distinct_words", "distinct_shingles", "letters", "upper", "digits", "spaces", "marks",
    "symbols", "bars", "exclamations", "beyond_ascii", "lines", "distinct_lines", "entropy",
)


def features(texts: list[str]) -> np.ndarray:
    """(texts, FEATURES): counts and shares over the whole texts."""
    out = np.zeros((len(texts), len(FEATURES)))
    words, counts = word_hashes(texts)
    for row, (text, w) in enumerate(zip(texts, by_text(words, counts), strict=True)):
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            continue
        h = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        n, lines = len(raw), [x for x in text.split("\n") if x.strip()]
        shingles = shingle_hashes(w)
        upper, lower, digits, spaces, beyond = h[65:91].sum(), h[97:123].sum(), h[48:58].sum(), h[9:14].sum() + h[32], h[128:].sum()
        marks = h[[44, 46, 59, 58, 39, 34, 63, 45]].sum()
        p = h[h > 0] / n
        out[row] = (
            np.log1p(len(w)), (n - spaces) / max(len(w), 1), len(np.unique(w)) / max(len(w), 1), len(np.unique(shingles)) / max(len(shingles), 1),
            (upper + lower) / n, upper / max(upper + lower, 1), digits / n, spaces / n, marks / n,
            h[[35, 42, 36, 37, 38, 60, 62]].sum() / n, h[124] / n, h[33] / n, beyond / n, np.log1p(len(lines)), len(set(lines)) / max(len(lines), 1), -(p * np.log2(p)).sum(),
        )
    return out


def _leaf(g: float, h: float) -> float:
    return -g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram along its one axis; place 0 is none."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    ok = (nl >= LEAST_ROWS) & (n.sum() - nl >= LEAST_ROWS)
    if not ok.any():
        return 0.0, 0
    gain = np.where(ok, gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1), 0.0)
    best = int(gain.argmax())
    return float(gain[best]), best + 1 if gain[best] > 1e-9 else 0


def tree_1d(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree over one feature's bins, as a table."""
    cut = _split(g, h, n)[1] if depth else 0
    if not cut:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([tree_1d(g[s], h[s], n[s], depth - 1) for s in (slice(0, cut), slice(cut, None))])


def tree_2d(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree over two features' bins, as a table; each node cuts along the better axis."""
    cuts = [_split(g.sum(1 - axis), h.sum(1 - axis), n.sum(1 - axis)) for axis in (0, 1)] if depth else [(0.0, 0)] * 2
    axis = int(cuts[1][0] > cuts[0][0])
    cut = cuts[axis][1]
    if not cut:
        return np.full(g.shape, _leaf(g.sum(), h.sum()))
    halves = [tuple(s if a == axis else slice(None) for a in (0, 1)) for s in (slice(0, cut), slice(cut, None))]
    return np.concatenate([tree_2d(g[s], h[s], n[s], depth - 1) for s in halves], axis=axis)


@dataclass
class Model:
    edges: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: np.ndarray | None = None
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities by vectorised additions of table entries."""
        z = np.full(len(x), self.base)
        if self.tables is not None:
            fine, coarse = self.bins(x, self.edges), self.bins(x, self.pair_edges)
            for f in range(x.shape[1]):
                z += self.tables[f][fine[:, f]]
            for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
                z += t[coarse[:, a], coarse[:, b]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of single features, then of the pairs with the largest joint gain."""
    if not len(y):
        return Model()
    quantiles = lambda f, n: np.unique(np.quantile(x[:, f], np.arange(1, n) / n))
    share = np.clip(y.mean(), 0.01, 0.99)
    model = Model([quantiles(f, BINS) for f in range(x.shape[1])], [quantiles(f, PAIR_BINS) for f in range(x.shape[1])], float(np.log(share / (1 - share))), np.zeros((x.shape[1], BINS)))
    fine, coarse, z = model.bins(x, model.edges), model.bins(x, model.pair_edges), np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(x.shape[1]):
            g, h = slopes()
            add = RATE * tree_1d(*(np.bincount(fine[:, f], v, BINS) for v in (g, h, np.ones(len(y)))))
            model.tables[f] += add
            z += add[fine[:, f]]
    flat = lambda a, b: coarse[:, a] * PAIR_BINS + coarse[:, b]
    joint = lambda a, b, v: np.bincount(flat(a, b), v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    g, h = slopes()
    gains = []
    for a in range(x.shape[1]):
        for b in range(a):
            gs, hs = joint(a, b, g), joint(a, b, h)
            gains.append((float((gs**2 / (hs + 1)).sum() - (gs.sum(0) ** 2 / (hs.sum(0) + 1)).sum() - (gs.sum(1) ** 2 / (hs.sum(1) + 1)).sum()), a, b))
    model.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            add = RATE * tree_2d(*(joint(a, b, v) for v in (g, h, np.ones(len(y)))))
            model.pair_tables[k] += add
            z += add[coarse[:, a], coarse[:, b]]
    return model


def with_features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and the features of every text."""
    kept = docs.select(*keep, text_or_empty().alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), "features array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in grouped(pc.binary_length(whole.column(len(keep))).to_pylist()):
                batch = whole.slice(s.start, s.stop - s.start)
                rows = features(batch.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(list(rows), pa.list_(pa.float64()))], [*batch.schema.names[: len(keep)], "features"])

    return kept.mapInArrow(run, schema)


def fit(labelled: DataFrame) -> Model:
    """Train on ``labelled`` (features, label 0 or 1): a hashed sample of at most SAMPLE_ROWS distinct rows, as many of each label."""
    usable = labelled.where("label is not null").select("features", F.col("label").cast("double").alias("label"))
    sample = drawn_apart(usable, "label", ["features"], SAMPLE_ROWS).toPandas()
    if sample.empty:
        return Model()
    x, y = np.stack(sample["features"].to_numpy()), sample["label"].to_numpy()
    order = np.lexsort((*x.T, y))
    model = train(x[order], y[order])
    shares = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}  # two labels
    if len(shares) == 2:  # the sample holds as many of both: the scores are moved to the rows' own share
        model.base += float(np.log(shares[1.0] / shares[0.0]) - np.log(max(y.sum(), 1) / max((1 - y).sum(), 1)))
    return model


def score(rows: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``score`` and ``predicted`` of rows that carry features."""
    kept = rows.select(*keep, "features")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), "score double, predicted int"])
    sent = rows.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            p = sent.value.scores(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], [*batch.schema.names[: len(keep)], "score", "predicted"])

    return kept.mapInArrow(run, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)))
    rows = stored(with_features(docs, keep=("doc_id", "held_out")), "features")
    labels = table(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("label"))
    model = fit(rows.where("not held_out").join(labels, "doc_id").select("features", "label"))
    return score(rows, model, keep=("doc_id", "held_out"))
