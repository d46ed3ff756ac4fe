"""A random forest whose upper levels are relations and whose lower subtrees grow side by side.

Values are dealt to at most ``BINS`` bins of a feature, so a row is a byte for each feature. While a node has more than ``LOCAL_ROWS`` rows,
its split comes from class counts per (tree, node, feature, bin) that Spark sums over all rows. A smaller node's rows meet in one group
(tree, node), which grows the rest of that subtree; such a group has at most ``LOCAL_ROWS`` rows whatever the table's size. The
driver holds the large nodes alone, the subtrees stay a table. Rows to be scored go the same way: through the large nodes, then
to the group of the subtree they fall into.

A row is in a tree as often as a Poisson draw of mean 1 by its number says. Each node looks at the root of the number of features, drawn by
tree and node. A missing value goes right, as does one above all that were fitted on. A node is split if it is shallower than ``depth``, has two classes, and some cut leaves ``min_rows``
rows on both sides with a gain.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.session import cut_lineage, discard

#: Bins of a feature: a 32nd of the values each, and one for missing values.
BINS = 33
#: Rows of a node, copies within a tree's draw counted once, up to which one group grows the subtree.
LOCAL_ROWS = 16_384
#: Large nodes of a tree whose counts are summed in one group.
NODES_TOGETHER = 32
#: Cells (node, bin, class) for each row of a level up to which all are counted.
CELLS_EACH = 2
MAX_DEPTH = 30
#: Gains below this are rounding.
LEAST_GAIN = 1e-12

# The functions below travel to the workers by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _mix(x: np.ndarray) -> np.ndarray:
    """Evenly spread 64-bit hashes (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _times(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in the tree: Poisson draws of mean 1."""
    start = _mix(np.array([(seed * 1_000_003 + tree) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0]
    unit = (_mix(ids.astype(np.uint64) ^ start) >> np.uint64(11)).astype(float) / 2.0**53
    steps = np.cumsum([math.exp(-1.0) / math.factorial(i) for i in range(19)])
    return np.searchsorted(steps, unit, side="right").astype(np.int32)


def _looked_at(tree: int, nodes: np.ndarray, features: int, seed: int) -> np.ndarray:
    """The features that each node may be cut by, a row for each node."""
    n = min(features, math.ceil(math.sqrt(features)))
    start = _mix(np.array([(seed * 1_000_003 + tree) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64) ^ np.uint64(0x5851F42D4C957F2D))[0]
    drawn = _mix(_mix(nodes.astype(np.uint64) ^ start)[:, None] ^ np.arange(features, dtype=np.uint64)[None, :])
    return np.sort(np.argsort(drawn, axis=1, kind="stable")[:, :n], axis=1)


def _codes(columns: Sequence[np.ndarray], bounds: Sequence[np.ndarray]) -> np.ndarray:
    """The bin of every value; a bin holds what is at most its bound, the last one larger and missing values."""
    return np.stack([np.searchsorted(b, x, side="left") for x, b in zip(columns, bounds, strict=True)], axis=1).astype(np.uint8)


def _best(left: np.ndarray, n_left: np.ndarray, total: np.ndarray, n: np.ndarray, min_rows: int) -> np.ndarray:
    """Gini gain of cuts with class weights ``left`` of ``total``; -1 where a side has too few rows."""
    right = total - left
    w_left, w_right, w = left.sum(-1), right.sum(-1), total.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        kept = ((left * left).sum(-1) / w_left + (right * right).sum(-1) / w_right) / w
        gain = kept - (total * total).sum(-1) / (w * w)
    return np.where((n_left >= min_rows) & (n - n_left >= min_rows) & (n_left > 0) & (n_left < n), gain, -1.0)


class Subtree:
    """A grown part of a tree as arrays: ``child`` is the left child's place (the right one follows) or -1 - place of a leaf's shares."""

    def __init__(self, feature, bin_, child, leaves):
        self.feature, self.bin, self.child, self.leaves = feature, bin_, child, leaves

    def shares(self, codes: np.ndarray) -> np.ndarray:
        at, open_ = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes))
        while True:
            open_ = open_[self.child[at[open_]] >= 0]
            if not len(open_):
                return self.leaves[-1 - self.child[at]]
            i = at[open_]
            at[open_] = self.child[i] + (codes[open_, self.feature[i]] > self.bin[i])


def _level_cuts(codes: np.ndarray, looked: np.ndarray, place: np.ndarray, y: np.ndarray, times: np.ndarray, total: np.ndarray, weights: np.ndarray, min_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, feature and bin of the best cut of every node of a level, the first of equal ones; the gain is 0 where none suits.

    ``codes`` has a line for each feature, ``place`` is each row's node, in order, and ``total`` the nodes' class counts. Where nodes hold many rows, class counts
    of every bin give all gains. Elsewhere the gains come from running sums of squares first, with a bound of their rounding, and the
    class counts are taken only for cuts that may be a node's best.
    """
    (nodes, classes), slots = total.shape, looked.shape[1]
    n, weighted, each = total.sum(1), total * weights, np.arange(nodes)
    gain, slot, bins = np.zeros(nodes), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    rows = np.arange(len(y))

    def exact(left: np.ndarray, node: np.ndarray) -> np.ndarray:
        return _best(left * weights, left.sum(1), weighted[node], n[node], min_rows)

    if nodes * BINS * classes <= CELLS_EACH * len(y):
        every = np.repeat(each, BINS)
        for s in range(slots):
            cells = np.bincount((place * BINS + codes[looked[place, s], rows]) * classes + y, times, nodes * BINS * classes).astype(np.int64)
            found = exact(np.cumsum(cells.reshape(nodes, BINS, classes), axis=1).reshape(-1, classes), every).reshape(nodes, BINS)
            b = found.argmax(axis=1)
            better = found[each, b] > np.maximum(gain, LEAST_GAIN)
            gain[better], slot[better], bins[better] = found[each, b][better], s, b[better]
        return gain, looked[each, slot], bins

    # All sums are of shares of the node's weight, so that a node's share of the running sums' rounding is bounded.
    w = weighted.sum(1, keepdims=True)
    squares = ((weighted / w) ** 2).sum(1)
    group, unit = place * classes + y, weights[y] / w[place, 0]
    earlier = (np.cumsum(total) - total.ravel())[group]
    share, doubled = times * unit, times * unit * unit
    met = share * (weighted / w).ravel()[group]
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    n_before = np.cumsum(n) - n
    slack = 16 * np.finfo(float).eps * len(y) * nodes
    shift = len(y).bit_length()
    by_group, by_node = (group * BINS) << shift | rows, (place * BINS) << shift | rows
    low, kept = np.zeros(nodes), []
    for s in range(slots):
        code = codes[looked[place, s], rows].astype(np.int64) << shift
        # A row adds to its class's square by how much of the class is left of it.
        i = np.sort(by_group + code) & ((1 << shift) - 1)
        t = times[i]
        added = np.empty(len(y))
        added[i] = doubled[i] * (2 * (np.cumsum(t) - t - earlier[i]) + t)
        key = np.sort(by_node + code)
        i, key = key & ((1 << shift) - 1), key >> shift
        ends = np.flatnonzero((key[1:] != key[:-1]) & (place[1:] == place[:-1]))
        node = place[ends]
        n_left = np.cumsum(times[i])[ends] - n_before[node]
        allowed = (n_left >= min_rows) & (n[node] - n_left >= min_rows)
        ends, node = ends[allowed], node[allowed]
        if not len(ends):
            continue

        def left_of(x: np.ndarray) -> np.ndarray:
            running = np.cumsum(x[i])
            return running[ends] - (running[starts] - x[i[starts]])[node]

        p, left = left_of(share), left_of(added)
        right = squares[node] - 2 * left_of(met) + left
        p, q = np.maximum(p, slack), np.maximum(1 - p, slack)
        about, wrong = left / p + right / q - squares[node], slack / np.minimum(p, q)
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        low[node[first]] = np.maximum(low[node[first]], np.maximum.reduceat(about - wrong, first))
        near = about + wrong >= low[node]
        kept.append((node[near], np.full(near.sum(), s), key[ends[near]] % BINS, (about + wrong)[near]))
    if not kept:
        return gain, looked[each, slot], bins
    node, s, b, high = (np.concatenate(x) for x in zip(*kept))
    near = np.flatnonzero(high >= low[node])
    near = near[np.argsort(node[near], kind="stable")]
    node, s, b = node[near], s[near], b[near]
    size = np.diff(np.r_[starts, len(y)])[node]
    cut = np.repeat(np.arange(len(node)), size)
    at = np.arange(len(cut)) + np.repeat(starts[node] - np.cumsum(size) + size, size)
    inside = codes[looked[node, s][cut], at] <= b[cut]
    cut, at = cut[inside], at[inside]
    found = exact(np.bincount(cut * classes + y[at], times[at], len(node) * classes).astype(np.int64).reshape(-1, classes), node)
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    hit = np.flatnonzero(found == np.repeat(np.maximum.reduceat(found, first), np.diff(np.r_[first, len(found)])))
    owner, where = np.unique(node[hit], return_index=True)
    better = found[hit[where]] > LEAST_GAIN
    owner, where = owner[better], hit[where[better]]
    gain[owner], slot[owner], bins[owner] = found[where], s[where], b[where]
    return gain, looked[each, slot], bins


def grow(codes: np.ndarray, y: np.ndarray, times: np.ndarray, weights: np.ndarray, tree: int, root: int, depth: int, min_rows: int, seed: int) -> tuple[Subtree, np.ndarray]:
    """The subtree below node ``root`` and the gain of each feature in it, times the weight it was made on.

    All nodes of a level are cut at once.
    """
    features, classes = codes.shape[1], len(weights)
    gains = np.zeros(features)
    feature, bins, child, leaves = [np.zeros(1, np.int16)], [np.zeros(1, np.uint8)], [np.full(1, -1, np.int32)], []
    by_feature = np.ascontiguousarray(codes.T)
    rows, at = np.arange(len(y)), np.zeros(len(y), np.int64)  # rows still moving, ordered by their node of this level
    heap, level, made, n_leaves = np.array([root], np.int64), root.bit_length() - 1, 1, 0
    while len(heap):
        nodes = len(heap)
        total = np.bincount(at * classes + y[rows], times[rows], nodes * classes).astype(np.int64).reshape(nodes, classes)
        n, weighted = total.sum(1), total * weights
        gain, cut_f, cut_b = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64)
        open_ = ((total > 0).sum(1) > 1) & (n >= 2 * min_rows) if level < depth else np.zeros(nodes, bool)
        if open_.any():
            moving = open_[at]
            live, place = rows[moving], (np.cumsum(open_) - 1)[at[moving]]
            ids = np.flatnonzero(open_)
            looked = _looked_at(tree, heap[ids], features, seed)
            top, f, b = _level_cuts(by_feature[:, live], looked, place, y[live], times[live], total[ids], weights, min_rows)
            found = top > 0
            cut_f[ids[found]], cut_b[ids[found]], gain[ids] = f[found], b[found], top
        split = cut_f >= 0
        np.add.at(gains, cut_f[split], gain[split] * weighted[split].sum(1))
        # This level's nodes are the last ones made.
        links = child[-1]
        links[split] = made + 2 * np.arange(split.sum())
        links[~split] = -1 - n_leaves - np.arange((~split).sum())
        feature[-1][split], bins[-1][split] = cut_f[split], cut_b[split]
        leaf = weighted[~split]
        leaves.append((leaf / leaf.sum(1, keepdims=True)).astype(np.float32))
        n_leaves += len(leaf)
        if not split.any():
            break
        moving = split[at]
        rows, at = rows[moving], at[moving]
        at = 2 * (np.cumsum(split) - 1)[at] + (codes[rows, cut_f[at]] > cut_b[at])
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        heap = (2 * heap[split][:, None] + np.arange(2)[None, :]).ravel()
        feature.append(np.zeros(len(heap), np.int16)), bins.append(np.zeros(len(heap), np.uint8)), child.append(np.zeros(len(heap), np.int32))
        made, level = made + len(heap), level + 1
    return Subtree(np.concatenate(feature), np.concatenate(bins), np.concatenate(child), np.concatenate(leaves)), gains


class Top:
    """The large nodes of a tree: cuts, and the shares of those that no cut suits. Other nodes below them are small."""

    def __init__(self):
        self.cut: dict[int, tuple[int, int]] = {}
        self.leaf: dict[int, np.ndarray] = {}

    def walk(self) -> tuple[Subtree, np.ndarray]:
        """The cuts as arrays, with the heap number of every place."""
        heap, i = [1], 0
        child, feature, bins = [], [], []
        while i < len(heap):
            f, b = self.cut.get(heap[i], (0, 0))
            child.append(len(heap) if heap[i] in self.cut else -1 - i)
            feature.append(f), bins.append(b)
            if heap[i] in self.cut:
                heap += [2 * heap[i], 2 * heap[i] + 1]
            i += 1
        heap = np.array(heap, np.int64)
        return Subtree(np.array(feature), np.array(bins), np.array(child), heap), heap

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """The heap number of the small node or large leaf that each row falls into."""
        return self.walk()[0].shares(codes)


def _runs(node: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each node and the places where it stands."""
    order = np.argsort(node, kind="stable")
    if len(order):
        starts = np.flatnonzero(np.r_[True, node[order][1:] != node[order][:-1]])
        for at in np.split(order, starts[1:]):
            yield int(node[at[0]]), at


def _whole(batches: Iterator[pa.RecordBatch], features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows of a partition, which is a split of a stored table."""
    parts = [_table(b, features) for b in batches]
    if not parts:
        return np.zeros(0, np.int64), np.zeros((0, features), np.uint8), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _table(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, features)
    return batch.column("id").to_numpy(), codes, batch.column("y").to_numpy() if "y" in batch.schema.names else None


def _coded(df: DataFrame, features: Sequence[str], bounds: Sequence[np.ndarray], others: Sequence) -> DataFrame:
    """``others`` (named columns) and the row's bins, a byte for each feature."""
    names = [f"f{i}" for i in range(len(features))]
    kept = df.select(*others, *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(features, names)])
    plain = [f for f in kept.schema.fields if f.name not in names]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names]
            codes = _codes(columns, bounds)
            packed = pa.array([row.tobytes() for row in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in plain], packed], names=[*[f.name for f in plain], "codes"])

    return kept.mapInArrow(encode, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in plain], "codes binary"]))


class Forest:
    """A fitted forest: ``tops`` by tree, the table of subtrees below them, and the importance of each feature."""

    def __init__(self, features, classes, bounds, tops, subtrees, prior, importance, rows):
        self.features, self.classes, self.bounds, self.tops, self.subtrees = list(features), classes, bounds, tops, subtrees
        self.prior, self._importance, self.rows = prior, importance, rows

    def importances(self) -> dict[str, float]:
        return dict(zip(self.features, self._importance))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability``, the mean class shares over the trees, and ``prediction``, the class with the largest (the first of equals)."""
        features, classes, tops = len(self.features), len(self.classes), self.tops
        stored = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
        coded = _coded(stored, self.features, self.bounds, [F.col("_row").alias("id")])

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                ids, codes, _ = _table(b, features)
                out = [], [], [], [], []
                known = np.zeros((len(ids), classes))
                for tree, top in enumerate(tops):
                    for node, at in _runs(top.nodes(codes)):
                        if node in top.leaf:
                            known[at] += top.leaf[node]
                            continue
                        for column, x in zip(out, (tree, node, ids[at].tobytes(), codes[at].tobytes(), None)):
                            column.append(x)
                for column, x in zip(out, (-1, int(ids[0]), ids.tobytes(), b"", known.tobytes())):
                    column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["tree", "node", "ids", "codes", "known"])

        sent = coded.mapInArrow(send, "tree int, node long, ids binary, codes binary, known binary")
        names = [f"s{c}" for c in range(classes)]

        def votes(ids: np.ndarray, shares: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame(shares.astype(float), columns=names).assign(id=ids)[["id", *names]]

        def score(rows: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
            if not len(rows):
                return votes(np.zeros(0, np.int64), np.zeros((0, classes)))
            ids = np.frombuffer(b"".join(rows["ids"]), np.int64)
            if rows["tree"].iloc[0] == -1:
                return votes(ids, np.frombuffer(b"".join(rows["known"])).reshape(-1, classes))
            if not len(part):  # a tree without rows
                return votes(ids, np.zeros((len(ids), classes)))
            p = part.iloc[0]
            subtree = Subtree(np.frombuffer(p["feature"], np.int16), np.frombuffer(p["bin"], np.uint8), np.frombuffer(p["child"], np.int32), np.frombuffer(p["leaves"], np.float32).reshape(-1, classes))
            return votes(ids, subtree.shares(np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(-1, features)))

        schema = "id long, " + ", ".join(f"{c} double" for c in names)
        # Many more rows than the forest was fitted on: the rows of a subtree come in lots.
        n = 1 + stored.count() // (16 * self.rows)
        lots = sent.withColumn("lot", F.pmod(F.xxhash64("ids"), F.lit(n))).groupBy("tree", "node", "lot")
        other = self.subtrees.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).groupBy("tree", "node", "lot")
        summed = lots.cogroup(other).applyInPandas(score, schema).groupBy("id").agg(*[F.sum(c).alias(c) for c in names])
        whole = sum((F.col(n) for n in names), F.lit(0.0))
        shares = F.when(whole > 0, F.array(*[F.col(n) / whole for n in names])).otherwise(F.array(*[F.lit(float(p)) for p in self.prior]))
        chosen = F.get(F.array(*[F.lit(float(c)) for c in self.classes]), (F.array_position("probability", F.array_max("probability")) - 1).cast("int"))
        scored = summed.select("id", shares.alias("probability")).withColumn("prediction", chosen)
        return stored.join(scored, F.col("_row") == F.col("id")).drop("_row", "id")


def _large_cuts(rows: DataFrame, active: dict[int, np.ndarray], tops: Sequence[Top], features: int, weights: np.ndarray, min_rows: int, seed: int) -> DataFrame:
    """The best cut of each large node in ``active`` by tree: (tree, node, f, b, gain, total, left); gain is 0 where none suits."""
    classes = len(weights)
    slots = min(features, math.ceil(math.sqrt(features)))
    shape = (-1, slots, BINS, classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes, y = _whole(batches, features)
        for tree, nodes in active.items():
            times = _times(ids, tree, seed)
            drawn = np.flatnonzero(times)
            at = tops[tree].nodes(codes[drawn])
            place = np.minimum(np.searchsorted(nodes, at), len(nodes) - 1)
            inside = nodes[place] == at
            drawn, place = drawn[inside], place[inside]
            if not len(drawn):
                continue
            looked = _looked_at(tree, nodes, features, seed)
            cells = [np.bincount((place * BINS + codes[drawn, looked[place, s]]) * classes + y[drawn], times[drawn], len(nodes) * BINS * classes) for s in range(slots)]
            counts = np.stack([c.reshape(len(nodes), BINS, classes) for c in cells], axis=1).astype(np.int32)
            starts = range(0, len(nodes), NODES_TOGETHER)
            out = [tree] * len(starts), list(starts), [counts[i : i + NODES_TOGETHER].tobytes() for i in starts]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.binary()))], names=["tree", "first", "counts"])

    def choose(parts: pd.DataFrame) -> pd.DataFrame:
        tree, first = int(parts["tree"].iloc[0]), int(parts["first"].iloc[0])
        counts = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in parts["counts"]).reshape(shape)
        nodes = active[tree][first : first + NODES_TOGETHER]
        left = np.cumsum(counts, axis=2)
        total = left[:, :, -1:, :]
        found = _best(left * weights, left.sum(-1), total * weights, total.sum(-1), min_rows).reshape(len(nodes), -1)
        best, each = found.argmax(axis=1), np.arange(len(nodes))
        slot, b = best // BINS, best % BINS
        return pd.DataFrame({
            "tree": tree, "node": nodes, "f": _looked_at(tree, nodes, features, seed)[each, slot], "b": b, "gain": np.maximum(found[each, best], 0.0),
            "total": list(total[:, 0, 0]), "left": list(left[each, slot, b]),
        })

    counted = rows.mapInArrow(count, "tree int, first int, counts binary")
    return counted.groupBy("tree", "first").applyInPandas(choose, "tree int, node long, f int, b int, gain double, total array<long>, left array<long>")


def _subtrees(rows: DataFrame, tops: Sequence[Top], n: int, features: int, weights: np.ndarray, depth: int, min_rows: int, seed: int) -> DataFrame:
    """The grown part below every small node: (tree, node, feature, bin, child, leaves, gains)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, codes, y = _whole(batches, features)
        for tree, top in enumerate(tops):
            times = _times(ids, tree, seed)
            drawn = np.flatnonzero(times)
            out = [], [], [], [], []
            for node, at in _runs(top.nodes(codes[drawn])):
                if node not in top.leaf:
                    at = drawn[at]
                    for column, x in zip(out, (tree, node, codes[at].tobytes(), y[at].astype(np.int16).tobytes(), times[at].astype(np.uint8).tobytes())):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["tree", "node", "codes", "y", "times"])

    def finish(parts: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(parts["tree"].iloc[0]), int(parts["node"].iloc[0])
        codes, y, times = (np.frombuffer(b"".join(parts[c]), t) for c, t in (("codes", np.uint8), ("y", np.int16), ("times", np.uint8)))
        part, gains = grow(codes.reshape(-1, features), y.astype(np.int64), times.astype(np.int32), weights, tree, node, depth, min_rows, seed)
        return pd.DataFrame({"tree": [tree], "node": [node], "feature": [part.feature.tobytes()], "bin": [part.bin.tobytes()], "child": [part.child.tobytes()], "leaves": [part.leaves.tobytes()], "gains": [gains]})

    # The work lies in the groups, not in their bytes: more tasks than cores, and more as the rows get more.
    tasks = max(4 * rows.sparkSession.sparkContext.defaultParallelism, n * len(tops) * features // 2**26)
    sent = rows.mapInArrow(send, "tree int, node long, codes binary, y binary, times binary").repartition(tasks, "tree", "node")
    return cut_lineage(sent.groupBy("tree", "node").applyInPandas(finish, "tree int, node long, feature binary, bin binary, child binary, leaves binary, gains array<double>"))


class Training:
    """Rows dealt to bins and stored, which any number of forests can be fitted on; ``close`` empties them."""

    def __init__(self, train: DataFrame, features: Sequence[str], label: str = "label_id"):
        self.features = list(features)
        labelled = train.where(F.col(label).isNotNull())
        sizes = sorted((r[0], r["n"]) for r in labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each class
        if not sizes:
            raise ValueError("no labelled rows")
        self.classes, self.counts = [c for c, _ in sizes], np.array([n for _, n in sizes])
        names = [f"f{i}" for i in range(len(self.features))]
        values = labelled.select(*[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(self.features, names)])
        self.bounds = [np.unique(q) for q in values.approxQuantile(names, [i / (BINS - 1) for i in range(1, BINS)], 0.001)]
        y = (F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col(label)) - 1).cast("long")
        # The number of a row is stored with it: a lost task draws the same rows again.
        self.rows = cut_lineage(_coded(labelled, self.features, self.bounds, [F.monotonically_increasing_id().alias("id"), y.alias("y")]))

    def close(self) -> None:
        discard(self.rows)


def fit_forest(train: DataFrame | Training, features: Sequence[str], label: str = "label_id", trees: int = 300, depth: int = 20, min_rows: int = 2, seed: int = 42) -> Forest:
    """Random forest with balanced class weights (n / (K * n_c)). Rows without a label don't count.

    ``Training`` of the same features and label serves several fits; it stays open.
    """
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be in 0 to {MAX_DEPTH}")
    data = train if isinstance(train, Training) else Training(train, features, label)
    rows, features, classes, counts, bounds = data.rows, data.features, data.classes, data.counts, data.bounds
    n = int(counts.sum())
    weights = n / (len(classes) * counts)
    tops, gains = [Top() for _ in range(trees)], np.zeros((trees, len(features)))
    active = {t: np.array([1], np.int64) for t in range(trees)} if n > LOCAL_ROWS and depth else {}
    while active:
        below: dict[int, list[int]] = {}
        for r in _large_cuts(rows, active, tops, len(features), weights, min_rows, seed).collect():  # a row for each large node
            top, total, left = tops[r["tree"]], np.array(r["total"]), np.array(r["left"])
            if r["gain"] <= LEAST_GAIN:
                top.leaf[r["node"]] = total * weights / (total * weights).sum()
                continue
            top.cut[r["node"]] = (r["f"], r["b"])
            gains[r["tree"], r["f"]] += r["gain"] * (total * weights).sum()
            for node, part in ((2 * r["node"], left), (2 * r["node"] + 1, total - left)):
                if part.sum() <= LOCAL_ROWS:
                    continue
                if node.bit_length() > depth or (part > 0).sum() < 2:
                    top.leaf[node] = part * weights / (part * weights).sum()
                else:
                    below.setdefault(r["tree"], []).append(node)
        active = {t: np.array(sorted(nodes), np.int64) for t, nodes in sorted(below.items())}
    subtrees = _subtrees(rows, tops, n, len(features), weights, depth, min_rows, seed)
    if data is not train:
        data.close()
    for r in subtrees.select("tree", F.posexplode("gains").alias("f", "g")).groupBy("tree", "f").agg(F.sum("g").alias("g")).collect():  # features by trees
        gains[r["tree"], r["f"]] += r["g"]
    each = gains.sum(axis=1, keepdims=True)
    mean = np.divide(gains, each, out=np.zeros_like(gains), where=each > 0).mean(axis=0)
    importance = (mean / (mean.sum() or 1.0)).tolist()
    return Forest(features, classes, bounds, tops, subtrees, counts * weights / n, importance, n)
