"""Nearest neighbours without a big group anywhere.

Exact: points are packed into blocks around a few pivots, which are drawn from all groups together. Every block of queries goes through
every block of points of its group by a plain product of the two stored tables, so nothing is copied to other tasks. A query's k-th
distance so far tells what can still be nearer: whole blocks by their centre and radius, single points by one matrix product in single precision
with room for its rounding; only what is left is measured exactly. Pivots decide the amount of work, never the result.

Buckets: every point falls into one bucket of each of several tables, by the signs of hashed projections; only
points that share a bucket are compared. The result is approximate and costs less than all pairs whatever the vectors. A bucket is cut
into blocks of limited size, and a pair of blocks is one matrix product.

Either way a pair of blocks returns only the nearest rows of each query, which are merged by key.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.functions.draws import draw_key
from furrow.session import cut_lineage, discard, small_batches, small_side

MAX_PIVOTS = 64
BLOCK_ROWS = 4_000
#: Queries of a block that are compared at once, and pairs that are measured at once.
QUERY_ROWS, MEASURED = 500, 100_000
#: Blocks of points in a task at least, where there are so many.
POINT_BLOCKS = 64
#: Pairs of blocks handed over at once.
PAIRS_TOGETHER = 4
#: Of the bucket index: more tables find more, more bits compare less.
TABLES, BITS = 12, 3
# Slack on every bound, so that rounding never prunes a neighbour.
SLACK = 1e-9

# The functions below travel to the workers by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=float) for x in vectors])


def _distances(point: np.ndarray, to: np.ndarray) -> np.ndarray:
    gap = to - point
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def _pivots(points: DataFrame, seed) -> np.ndarray:
    """Up to ``MAX_PIVOTS`` random points, whatever their group; fewer where a few blocks hold all."""
    n = max(1, min(MAX_PIVOTS, points.count() // BLOCK_ROWS))
    drawn = points.select(draw_key(seed, "key").alias("_h"), "key", "vec").orderBy("_h", "key").limit(n)
    return np.array([r["vec"] for r in drawn.collect()], dtype=float)


def _assign(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot ``cell`` and the distance ``d`` to it."""

    @F.pandas_udf("cell int, d double")
    def nearest(vec: pd.Series) -> pd.DataFrame:
        x = _stack(vec)
        cell, dist = np.zeros(len(x), dtype=np.int32), np.full(len(x), np.inf)
        for i, p in enumerate(pivots):
            d = _distances(p, x)
            closer = d < dist
            dist[closer], cell[closer] = d[closer], i
        return pd.DataFrame({"cell": cell, "d": dist})

    # Otherwise a join on ``cell`` repeats the function in a filter pushed down to the scan.
    nearest = nearest.asNondeterministic()
    return points.withColumn("_a", nearest("vec")).select("*", "_a.*").drop("_a")


def _packed(every: DataFrame, seed) -> tuple[DataFrame, DataFrame]:
    """The points with their cell, and blocks of them: rows (g, alone, block, keys and values of its points and of its queries).

    ``alone`` marks blocks that hold all of a group.
    """
    stored = cut_lineage(every)
    cells = cut_lineage(_assign(stored, _pivots(stored, seed)).select("g", "key", "vec", "is_query", "cell"))
    discard(stored)
    sizes = cells.groupBy("g", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.sum("n").over(Window.partitionBy("g")))
    sizes = small_side(sizes.select("g", "cell", (F.col("_all") <= BLOCK_ROWS).alias("alone"), F.ceil(F.col("n") / BLOCK_ROWS).alias("lots")))
    dealt = cells.join(sizes, ["g", "cell"]).select(
        "g", "alone", F.when(F.col("alone"), 0).otherwise(F.col("cell")).alias("cell"), F.when(F.col("alone"), 0).otherwise(F.pmod(F.xxhash64("key"), F.col("lots"))).alias("lot"), "key", "vec", "is_query"
    )

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        x, keys, asked = _stack(rows["vec"]), rows["key"].to_numpy(object), rows["is_query"].to_numpy(bool)
        first = rows.iloc[0]
        return pd.DataFrame({
            "g": [first["g"]], "alone": [first["alone"]], "block": [f"{first['cell']},{first['lot']},{first['g']}"],
            "q_keys": [keys[asked].tolist()], "q_vecs": [x[asked].tobytes()], "p_keys": [keys.tolist()], "p_vecs": [x.tobytes()],
        })

    packed = dealt.groupBy("g", "alone", "cell", "lot").applyInPandas(pack, "g string, alone boolean, block string, q_keys array<string>, q_vecs binary, p_keys array<string>, p_vecs binary")
    return cells, cut_lineage(packed)


class _Nearest:
    """The k nearest points so far of the queries of a block; ties go to the smaller key."""

    def __init__(self, keys: np.ndarray, q: np.ndarray, k: int):
        self.keys, self.q, self.k = keys, q, k
        self.centre = q.mean(axis=0)
        self.radius = _distances(self.centre, q).max()
        self.limit = np.full(len(q), np.inf)
        self.at, self.names, self.distance = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)

    def see(self, keys: np.ndarray, p: np.ndarray) -> None:
        centre = p.mean(axis=0)
        apart, radius = _distances(self.centre, centre[None, :])[0], _distances(centre, p).max()
        if apart - self.radius - radius > self.limit.max() + SLACK * (1.0 + apart + self.radius + radius):
            return
        own = {name: j for j, name in enumerate(keys)}
        own = np.array([own.get(name, -1) for name in self.keys])
        # Around the block's centre, so that values far from the origin lose nothing. The last column adds the points' own squares.
        point = p - centre
        squares = np.einsum("ij,ij->i", point, point)
        right = np.concatenate([point, squares[:, None]], axis=1).astype(np.float32).T
        far = np.sqrt(squares.max())
        found = []
        for start in range(0, len(self.q), QUERY_ROWS):
            part = slice(start, start + QUERY_ROWS)
            query = self.q[part] - centre
            qq = np.einsum("ij,ij->i", query, query)
            near = np.concatenate([-2.0 * query, np.ones((len(query), 1))], axis=1).astype(np.float32) @ right
            # Single precision: an error for each product and sum, of values up to this size.
            room = 2.4e-7 * (p.shape[1] + 8) * (np.sqrt(qq) + far) ** 2
            itself = np.flatnonzero(own[part] >= 0)
            near[itself, own[part][itself]] = np.inf
            limit = self.limit[part] ** 2 - qq + room
            fresh = np.flatnonzero(~np.isfinite(limit))
            if len(fresh):
                limit[fresh] = np.inf if near.shape[1] <= self.k else np.partition(near[fresh], self.k - 1, axis=1)[:, self.k - 1] + 2 * room[fresh]
            # Rounded up: the comparison is in single precision.
            bound = np.nextafter(limit.astype(np.float32), np.float32(np.inf))
            close = near <= bound[:, None]
            close[itself, own[part][itself]] = False
            # Of a plain array numpy finds the few true places several times faster.
            at = np.flatnonzero(close)
            for cut in range(0, len(at), MEASURED):
                ii, jj = np.divmod(at[cut : cut + MEASURED], near.shape[1])
                ii += start
                gap = p[jj] - self.q[ii]
                distance = np.sqrt(np.einsum("ij,ij->i", gap, gap))
                kept = distance <= self.limit[ii]
                found.append((ii[kept], jj[kept], distance[kept]))
        if found:
            at, j, distance = (np.concatenate(x) for x in zip(*found))
            self._merge(at, keys[j], distance)

    def _merge(self, at: np.ndarray, names: np.ndarray, distance: np.ndarray) -> None:
        touched = np.zeros(len(self.q), bool)
        touched[at] = True
        old = touched[self.at]
        at, names, distance = np.concatenate([at, self.at[old]]), np.concatenate([names, self.names[old]]), np.concatenate([distance, self.distance[old]])
        order = np.lexsort((distance, at))
        if ((at[order][1:] == at[order][:-1]) & (distance[order][1:] == distance[order][:-1])).any():
            order = np.lexsort((np.unique(names.astype(str), return_inverse=True)[1], distance, at))
        at, names, distance = at[order], names[order], distance[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        full = place == self.k - 1
        self.limit[at[full]] = distance[full]
        kept = place < self.k
        self.at, self.names, self.distance = (np.concatenate([a[~old], b[kept]]) for a, b in ((self.at, at), (self.names, names), (self.distance, distance)))

    def rows(self) -> pa.RecordBatch:
        columns = [pa.array(self.keys[self.at], pa.string()), pa.array(self.names, pa.string()), pa.array(self.distance, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=["key", "neighbour", "distance"])


def _product(blocks: DataFrame, k: int) -> DataFrame:
    """(key, neighbour, distance): for every query its nearest points of each task that its block met."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, state = None, None
        for b in batches:
            for r in range(b.num_rows):
                at = b.column("block")[r].as_py()
                if at != block:
                    if state:
                        yield state.rows()
                    keys = np.array(b.column("q_keys")[r].as_py(), object)
                    block, state = at, _Nearest(keys, np.frombuffer(b.column("q_vecs")[r].as_buffer()).reshape(len(keys), -1), k)
                names = np.array(b.column("p_keys")[r].as_py(), object)
                state.see(names, np.frombuffer(b.column("p_vecs")[r].as_buffer()).reshape(len(names), -1))
        if state:
            yield state.rows()

    n = blocks.where("not alone").count()
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    queries = blocks.where(F.size("q_keys") > 0).select("g", "alone", "block", "q_keys", "q_vecs")
    points = blocks.select(F.col("g").alias("_g"), F.col("alone").alias("_alone"), "p_keys", "p_vecs")
    small = queries.where("alone").join(points.where("_alone"), F.col("g") == F.col("_g"))
    # Each side is read where it lies; the condition is no equality, so groups are not dealt out by name.
    left = queries.where("not alone").repartition(max(1, min(n, 4 * cores)))
    right = points.where("not _alone").repartition(max(1, n // POINT_BLOCKS)).hint("shuffle_replicate_nl")
    large = left.join(right, (F.col("g") <= F.col("_g")) & (F.col("g") >= F.col("_g")))
    columns = ["block", "q_keys", "q_vecs", "p_keys", "p_vecs"]
    out = small.select(*columns).unionByName(large.select(*columns)) if n else small.select(*columns)
    with small_batches(blocks.sparkSession, PAIRS_TOGETHER):
        return cut_lineage(out.mapInArrow(compare, "key string, neighbour string, distance double"))


def _buckets(every: DataFrame, seed, tables: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """Queries and points in one bucket of each table, as ``at``."""

    @F.pandas_udf("array<long>")
    def codes(vec: pd.Series) -> pd.Series:
        x = _stack(vec)
        planes = np.random.default_rng([seed & 0x7FFFFFFF, x.shape[1]]).normal(size=(x.shape[1], tables * bits))
        sides = (x @ planes > 0).reshape(len(x), tables, bits)
        return pd.Series(list((sides @ (1 << np.arange(bits)) + (np.arange(tables) << bits)).astype(np.int64)))

    placed = cut_lineage(every.withColumn("at", F.explode(codes.asNondeterministic()("vec"))))
    return placed.where("is_query"), placed


def meetings(queries: DataFrame, points: DataFrame) -> DataFrame:
    """(g, at, n_q, n_p): how many queries meet how many points. Their products add up to the pairs that are compared."""
    n_q = queries.groupBy("g", "at").agg(F.count(F.lit(1)).alias("n_q"))
    n_p = points.groupBy("g", "at").agg(F.count(F.lit(1)).alias("n_p"))
    return n_q.join(n_p, ["g", "at"])


def _blocks(queries: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut both sides of a cell into hashed blocks and pair every query block with every point block."""
    sizes = meetings(queries, points).select("g", "at", F.ceil(F.col("n_q") / BLOCK_ROWS).alias("qs"), F.ceil(F.col("n_p") / BLOCK_ROWS).alias("ps"))
    hashed = F.pmod(F.xxhash64("key"), F.lit(2**31))

    def side(df: DataFrame, own: str, other: str, own_block: str, other_block: str) -> DataFrame:
        cut = df.join(sizes, ["g", "at"]).withColumn(own_block, (hashed % F.col(own)).cast("int"))
        return cut.withColumn(other_block, F.explode(F.sequence(F.lit(0), F.col(other).cast("int") - 1))).select("g", "at", "qb", "pb", "key", "vec")

    return side(queries, "qs", "ps", "qb", "pb"), side(points, "ps", "qs", "pb", "qb")


def closest(names: np.ndarray, q: np.ndarray, keys: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, distance) of the k nearest other points of each query; ties go to the smaller key.

    A matrix product finds all pairs that can be among the k, rounding included; only their distances are taken exactly.
    """
    order = np.argsort(keys, kind="stable")
    keys, p = keys[order], p[order]
    qq, pp = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", p, p)
    near = qq[:, None] + pp[None, :] - 2 * (q @ p.T)
    at = np.minimum(np.searchsorted(keys, names), len(keys) - 1)
    own = np.flatnonzero(keys[at] == names)
    near[own, at[own]] = np.inf
    if near.shape[1] > k:
        limit = np.partition(near, k - 1, axis=1)[:, k - 1]
        near = near <= (limit + SLACK * (1.0 + qq + pp.max()))[:, None]
    else:
        near = np.isfinite(near)
    i, j = np.nonzero(near)
    gap = p[j] - q[i]
    distance = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    order = np.lexsort((j, distance, i))
    i, j, distance = i[order], j[order], distance[order]
    first = np.searchsorted(i, i)  # where each query's run begins
    kept = np.arange(len(i)) - first < k
    return i[kept], keys[j[kept]], distance[kept]


def _compared(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(key, neighbour, distance) of the k nearest points in all blocks that share a bucket."""

    def compare(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(p):
            return pd.DataFrame(columns=["key", "neighbour", "distance"])
        names = q["key"].to_numpy(object)
        i, neighbour, distance = closest(names, _stack(q["vec"]), p["key"].to_numpy(object), _stack(p["vec"]), k)
        return pd.DataFrame({"key": names[i], "neighbour": neighbour, "distance": distance})

    ids = ["g", "at", "qb", "pb"]
    # Both sides stem from one table: fresh column identities keep the cogroup unambiguous.
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    found = left.groupBy(*ids).cogroup(right.groupBy(*ids)).applyInPandas(compare, "key string, neighbour string, distance double")
    return found.groupBy("key", "neighbour").agg(F.min("distance").alias("distance"))  # met in several tables


def nearest_neighbours(points: DataFrame, queries: DataFrame, k: int, by: str | None = None, key: str = "parcel_id", vec: str = "vec", seed: int = 42, method: str = "exact", tables: int = TABLES, bits: int = BITS) -> DataFrame:
    """The k nearest other points of each query, within its ``by`` group if given.

    ``queries`` are some of the ``points``. Returns (key, neighbour, distance, rank); ties go to
    the smaller key. Fewer than k rows come back only where a group is that small, or with the
    approximate ``method="buckets"`` where so few points share a bucket.
    """
    if method not in ("exact", "buckets"):
        raise ValueError(f"unknown method: {method}")
    group = F.col(by).cast("string") if by else F.lit("")
    cols = [group.alias("g"), F.col(key).cast("string").alias("key"), F.col(vec).alias("vec")]
    every = points.select(*cols)
    asked = queries.select(*cols)

    # Of equal points only the k + 1 smallest keys can be anyone's neighbour. The rank limit is
    # pushed below the exchange, so many copies of one point do not meet in a task.
    copies = Window.partitionBy("g", "vec").orderBy("key")
    few = every.withColumn("_c", F.row_number().over(copies)).where(F.col("_c") <= k + 1).drop("_c")
    flagged = few.join(asked.select("key", F.lit(True).alias("is_query")), "key", "left").withColumn("is_query", F.coalesce("is_query", F.lit(False)))
    if method == "exact":
        few, blocks = _packed(flagged, seed)
        found = _product(blocks, k)
        discard(blocks)
    else:
        left, right = _blocks(*_buckets(flagged, seed, tables, bits))
        found = _compared(left, right, k)

    # Queries beyond the first k + 1 copies of a point: the first k copies are their neighbours.
    heads = few.groupBy("g", "vec").agg(F.slice(F.array_sort(F.collect_list("key")), 1, k).alias("_n"))
    more = asked.join(few.select("key"), "key", "left_anti").join(heads, ["g", "vec"])
    found = found.unionByName(more.select("key", F.explode("_n").alias("neighbour"), F.lit(0.0).alias("distance")))

    order = Window.partitionBy("key").orderBy("distance", "neighbour")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(F.col("key").alias(key), "neighbour", "distance", "rank")
    )
