"""A classification tree by exact split search, as relations.

A level of the tree takes two passes over the rows. The first counts classes per (node, feature, range of values). The second sends every
feature's values to their range, where they are ordered; running sums of their class counts, on top of those of the ranges
below, are the class counts left of every possible cut, from which the Gini gain follows. Nothing but
one best cut for each node comes back to the driver, so the tree's size is all it holds.

A feature may have as many values as there are rows. The number of ranges grows with the rows, and equal values travel as one with
their count, so no task holds more than some ranges of one feature.

Rows go left if their value is at most the threshold, the middle between two neighbouring values. A missing or NaN value goes left
and takes no part in the search. Of equal gains the first feature, then the lowest threshold wins. A node is split if it
is shallower than ``depth``, has two classes, and some cut leaves ``min_rows`` rows on both sides with a gain above ``min_gain``.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.session import cut_lineage, discard

#: Ranges that the values of a feature are dealt to before they are ordered: for so many rows each, and at least one.
RANGE_ROWS = 100_000
#: At least so many, if there are as many values.
RANGES = 8
#: Decimals of a gain that count: equal gains whose sums were taken in another order stay equal.
DIGITS = 10


# The functions below travel to the workers by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Node:
    """Node ids are those of a heap: the children of n are 2 n and 2 n + 1."""

    node: int
    depth: int
    n: int
    counts: tuple[int, ...]
    prediction: object
    feature: str | None = None
    threshold: float | None = None
    gain: float = 0.0


def _columns(batch: pa.RecordBatch, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    values = [batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names]
    # No negative zero: equal values look alike.
    return batch.column("node").to_numpy(), batch.column("y").to_numpy().astype(np.int64), [v + 0.0 for v in values]


def range_bounds(rows: DataFrame, features: Sequence[str], n: int) -> list[np.ndarray]:
    """Where the ranges of each feature end; they decide the amount of work in a task, never the result."""
    ranges, names = max(RANGES, n // RANGE_ROWS), [f"f{i}" for i in range(len(features))]
    every = rows.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(features, names)]).approxQuantile(names, [i / ranges for i in range(1, ranges)], min(0.01, 0.25 / ranges)) if ranges > 1 else [[] for _ in features]
    return [np.unique(q) for q in every]


def best_cuts(rows: DataFrame, features: Sequence[str], classes: int, bounds: Sequence[np.ndarray], min_rows: int, min_gain: float) -> DataFrame:
    """One cut for each node of ``rows`` (node, y: 0 to classes - 1, features) that can be split: node, f, threshold, gain."""
    names = [f"f{i}" for i in range(len(features))]
    rows = rows.select("node", "y", *[F.col(f"`{c}`").alias(x) for c, x in zip(features, names)])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, y, values = _columns(b, names)
            heads, place = np.unique(node, return_inverse=True)
            for f, v in enumerate(values):
                known = ~np.isnan(v)
                size = len(bounds[f]) + 1
                ranged = place[known] * size + np.searchsorted(bounds[f], v[known])
                code, n = np.unique(ranged * classes + y[known], return_counts=True)
                out = heads[code // classes // size], np.full(len(code), f, np.int32), (code // classes % size).astype(np.int32), (code % classes).astype(np.int32), n.astype(np.int64)
                low = pd.Series(v[known]).groupby(ranged).min()  # of all classes
                yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(low.loc[code // classes].to_numpy())], names=["node", "f", "r", "c", "n", "low"])

    per_range = rows.mapInArrow(totals, "node long, f int, r int, c int, n long, low double").groupBy("node", "f", "r", "c").agg(F.sum("n").alias("n"), F.min("low").alias("low"))
    # Rows of this table: nodes by features by ranges by classes.
    entries = F.array_sort(F.collect_list(F.struct("node", "r", "c", "n", "low")))
    below = per_range.groupBy("f").agg(entries.alias("t"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, y, values = _columns(b, names)
            out = [], [], [], [], [], []
            for f, v in enumerate(values):
                known = np.flatnonzero(~np.isnan(v))
                r = np.searchsorted(bounds[f], v[known])
                order = known[np.lexsort((y[known], node[known], v[known]))]
                r = np.sort(r)  # ranges follow the values
                fresh = np.flatnonzero(np.r_[True, (v[order][1:] != v[order][:-1]) | (node[order][1:] != node[order][:-1]) | (y[order][1:] != y[order][:-1])]) if len(order) else np.zeros(0, int)
                n = np.diff(np.r_[fresh, len(order)])
                order, r = order[fresh], r[fresh]
                starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, int)
                for a, z in zip(starts, np.r_[starts[1:], len(r)]):
                    at = order[a:z]
                    for column, x in zip(out, (f, int(r[a]), v[at].tobytes(), node[at].tobytes(), y[at].astype(np.int32).tobytes(), n[a:z].astype(np.int64).tobytes())):
                        column.append(x)
            kinds = pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["f", "r", "v", "node", "y", "n"])

    def search(parts: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(parts) and len(totals):
            f, r = int(parts["f"].iloc[0]), int(parts["r"].iloc[0])
            v, node, y, n = (np.frombuffer(b"".join(parts[c]), t) for c, t in (("v", float), ("node", np.int64), ("y", np.int32), ("n", np.int64)))
            table = totals["t"].iloc[0]
            t_node, t_r, t_c, t_n, t_low = (np.array([e[c] for e in table]) for c in ("node", "r", "c", "n", "low"))
            for here in np.unique(node):
                own, all_ = node == here, t_node == here
                whole, left = (np.bincount(t_c[at], t_n[at], classes).astype(np.int64) for at in (all_, all_ & (t_r < r)))
                later = t_low[all_ & (t_r > r)]
                value, place = np.unique(v[own], return_inverse=True)
                counts = np.bincount(place * classes + y[own], n[own], len(value) * classes).astype(np.int64).reshape(-1, classes)
                left = np.cumsum(counts, axis=0) + left
                following = np.r_[value[1:], later.min() if len(later) else np.nan]
                cut = (value + following) / 2
                total, n_left = whole.sum(), left.sum(axis=1)
                n_right = total - n_left
                allowed = ~np.isnan(following) & (n_left >= min_rows) & (n_right >= min_rows) & (n_left > 0) & (n_right > 0)
                if not allowed.any():
                    continue
                right = whole - left
                with np.errstate(divide="ignore", invalid="ignore"):
                    impure = lambda c, m: 1.0 - ((c / m[:, None]) ** 2).sum(axis=1)
                    gain = 1.0 - ((whole / total) ** 2).sum() - n_left / total * impure(left, n_left) - n_right / total * impure(right, n_right)
                gain = np.where(allowed, np.round(gain, DIGITS), -1.0)
                best = int(gain.argmax())  # the first of equals
                if gain[best] > min_gain:
                    found.append((int(here), f, float(cut[best]), float(gain[best])))
        return pd.DataFrame(found, columns=["node", "f", "threshold", "gain"])

    sent = rows.mapInArrow(send, "f int, r int, v binary, node binary, y binary, n binary")
    ranges = F.explode(F.sequence(F.lit(0), F.element_at(F.array(*[F.lit(len(b)) for b in bounds]), F.col("f") + 1))).alias("r")
    each = below.select("f", ranges, "t").groupBy("f", "r")
    found = sent.groupBy("f", "r").cogroup(each).applyInPandas(search, "node long, f int, threshold double, gain double")
    return found.groupBy("node").agg(F.max_by(F.struct("f", "threshold", "gain"), F.struct("gain", -F.col("f"), -F.col("threshold"))).alias("b")).select("node", "b.*")


class ExactTree:
    """Nodes of a fitted tree; ``classes`` are the label values in order."""

    def __init__(self, nodes: list[Node], features: Sequence[str], classes: list):
        self.nodes, self.features, self.classes = sorted(nodes, key=lambda n: n.node), list(features), classes

    def _walk(self, node: int, value) -> Column:
        """``value`` of the leaf that a row reaches, as one expression."""
        at = {n.node: n for n in self.nodes}
        n = at[node]
        if n.feature is None:
            return F.lit(value(n))
        x = F.col(f"`{n.feature}`").cast("double")
        return F.when(x.isNull() | F.isnan(x) | (x <= F.lit(n.threshold)), self._walk(2 * node, value)).otherwise(self._walk(2 * node + 1, value))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``leaf``, the leaf's node id, and ``prediction``, its commonest label (the smallest of equals)."""
        return df.withColumn("leaf", self._walk(1, lambda n: n.node)).withColumn("prediction", self._walk(1, lambda n: n.prediction))

    def importances(self) -> dict[str, float]:
        """Gain weighted by rows, as shares of all gain."""
        total = sum(n.n * n.gain for n in self.nodes) or 1.0
        return {f: sum(n.n * n.gain for n in self.nodes if n.feature == f) / total for f in self.features}

    def table(self, spark) -> DataFrame:
        """A row for each node; leaves have no feature."""
        rows = [(n.node, n.depth, n.n, n.feature, n.threshold, n.gain, str(n.prediction)) for n in self.nodes]
        return spark.createDataFrame(rows, "node long, depth int, n long, feature string, threshold double, gain double, prediction string")


def fit_exact_tree(train: DataFrame, features: Sequence[str], label: str = "label_id", depth: int = 3, min_rows: int = 2, min_gain: float = 0.0) -> ExactTree:
    """One level is one search over all its nodes. Rows without a label don't count."""
    features = list(features)
    classes = sorted(r[0] for r in train.where(F.col(label).isNotNull()).select(label).distinct().collect())  # the label values
    if not classes:
        raise ValueError("no labelled rows")
    y = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    rows = cut_lineage(train.where(F.col(label).isNotNull()).select(F.lit(1).cast("long").alias("node"), y.cast("int").alias("y"), *[F.col(f"`{c}`").cast("double").alias(c) for c in features]))
    bounds = range_bounds(rows, features, rows.count()) if depth else []
    nodes: list[Node] = []
    for level in range(depth + 1):
        sizes = rows.groupBy("node").agg(*[F.count_if(F.col("y") == c).alias(f"n{c}") for c in range(len(classes))]).collect()  # a row for each node
        counts = {r["node"]: tuple(r[f"n{c}"] for c in range(len(classes))) for r in sizes}
        chosen = {}
        if level < depth:
            for r in best_cuts(rows, features, len(classes), bounds, min_rows, min_gain).collect():  # a row for each node
                chosen[r["node"]] = r
        for node, c in counts.items():
            best, prediction = chosen.get(node), classes[c.index(max(c))]
            nodes.append(Node(node, level, sum(c), c, prediction, *((features[best["f"]], best["threshold"], best["gain"]) if best else ())))
        if not chosen:
            break
        moves = F.lit(None).cast("long")
        for node, r in chosen.items():
            x = F.col(f"`{features[r['f']]}`")
            goes = F.when(x.isNull() | F.isnan(x) | (x <= F.lit(r["threshold"])), F.lit(2 * node)).otherwise(F.lit(2 * node + 1)).cast("long")
            moves = F.when(F.col("node") == node, goes).otherwise(moves)
        before, rows = rows, cut_lineage(rows.withColumn("node", moves).where("node is not null"))
        discard(before)
    discard(rows)
    return ExactTree(nodes, features, classes)

