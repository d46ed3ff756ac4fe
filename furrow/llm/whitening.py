"""Embedding whitening with eigenvectors refined in mixed precision.

Entries become whole numbers floor(256 * c). Every distinct vector counts once in the fit: packed into bytes, such vectors are
told apart by one shuffle. Their number and sums are exact; the covariance is summed over centred vectors in the tasks that
hold them, so what meets is one matrix a task. The driver keeps matrices of dimensions by dimensions, whatever the rows.

The eigenvectors of the covariance are taken in single precision first. Ogita-Aishima steps then correct them by matrix
products in extended precision, each step doubling the number of right digits. Vectors whose eigenvalues lie too close together for
a step to tell apart are turned by the eigenvectors of the small matrix that the cluster spans, shifted by its mean eigenvalue.

Null vectors and those with a null or non-finite entry are dropped, as are vectors of another length than the commonest
(of two equally common lengths, the greater). Entries beyond the range of a long are taken as its ends. Repeated rows all come
back, a null vec_id too. A deviation that no long can hold is null. Components without any spread (a single distinct vector,
constant dimensions) have a null whitened value, and the identity error is taken over the others (null if there are none); ties
between equal eigenvalues give some basis of their space. Extra columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import emptied, stored, table

SCALE = 256
COMPONENTS = 4
#: Dimensions of the covariance in one row while it is summed.
BLOCK = 64
#: Steps of refinement at most; each doubles the right digits, seven of which are there at the start.
STEPS = 12
#: Vectors that a task holds as doubles at a time.
BATCH = 4096
WIDE = np.longdouble


# -- whole vectors ----------------------------------------------------------------------------


def usable(column: pa.Array) -> np.ndarray:
    """Which vectors are there in whole and finite."""
    flat = pc.list_flatten(column)
    good = np.asarray(pc.fill_null(pc.is_finite(pc.cast(flat, pa.float64())), False).to_numpy(zero_copy_only=False), bool)
    at = np.asarray(pc.list_parent_indices(column).to_numpy(zero_copy_only=False), np.int64)
    ok = ~np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
    ok[at[~good]] = False
    return ok


def whole(column: pa.Array, dims: int) -> np.ndarray:
    """A row of longs for each vector of ``column``, all of ``dims`` finite entries."""
    values = np.asarray(pc.cast(pc.list_flatten(column), pa.float64()).to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
    with np.errstate(over="ignore"):
        low = np.floor(values * SCALE)
    out = np.clip(low, -(2.0**63), 2.0**62).astype(np.int64)
    out[low >= 2.0**63] = np.iinfo(np.int64).max
    between = (low > 2.0**62) & (low < 2.0**63)
    out[between] = low[between].astype(np.int64)
    return out


def packed(x: np.ndarray) -> list[bytes]:
    """Equal rows give equal bytes: the entries in the fewest bytes that hold all of a row."""
    out: list[bytes] = [b""] * len(x)
    low, high = x.min(axis=1), x.max(axis=1)
    left = np.ones(len(x), bool)
    for kind in (np.int8, np.int16, np.int32, np.int64):
        limits = np.iinfo(kind)
        fits = left & (low >= limits.min) & (high <= limits.max)
        for i in np.flatnonzero(fits):
            out[i] = x[i].astype(f"<i{kind().itemsize}").tobytes()
        left &= ~fits
    return out


def unpacked(rows: list[bytes], dims: int) -> np.ndarray:
    out = np.empty((len(rows), dims), np.int64)
    for i, raw in enumerate(rows):
        out[i] = np.frombuffer(raw, f"<i{len(raw) // dims}")
    return out


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def commonest_length(rows: DataFrame) -> int:
    """The length that most usable vectors have; 0 without any."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pc.list_value_length(batch.column(0).filter(pa.array(usable(batch.column(0)))))
            yield pa.RecordBatch.from_arrays([pc.cast(n, pa.int32())], ["length"])

    found = rows.select("embedding").mapInArrow(lengths, "length int").where("length > 0").groupBy("length").count()
    top = found.orderBy(F.desc("count"), F.desc("length")).first()
    return top["length"] if top else 0


def distinct_vectors(rows: DataFrame, dims: int) -> DataFrame:
    """Each distinct vector once, as bytes in the column x."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept = of_length(batch, dims)
            if kept.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(packed(whole(kept.column(0), dims)), pa.binary())], ["x"])

    return rows.select("embedding").mapInArrow(pack, "x binary").distinct()


def of_length(batch: pa.RecordBatch, dims: int) -> pa.RecordBatch:
    """The rows whose first column is a usable vector of ``dims`` entries."""
    column = batch.column(0)
    right = pc.fill_null(pc.equal(pc.list_value_length(column), dims), False)
    return batch.filter(pc.and_(pa.array(usable(column)), right))


# -- exact sums and the covariance ------------------------------------------------------------


def exact_sums(vectors: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension, exactly."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, [0] * dims, [0] * dims
        for batch in slices(batches):
            x = unpacked(batch.column(0).to_pylist(), dims)
            n += len(x)
            for sums, half in ((high, x >> 32), (low, x & 0xFFFFFFFF)):  # halves don't overflow within a slice
                for j, s in enumerate(half.sum(axis=0).tolist()):
                    sums[j] += s
        if n:
            values = [str(n), *[str((h << 32) + s) for h, s in zip(high, low, strict=True)]]
            yield pa.RecordBatch.from_arrays([pa.array(range(dims + 1), pa.int32()), pa.array(values)], ["dim", "value"])

    sums = vectors.mapInArrow(add, "dim int, value string").groupBy("dim").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("value"))
    found = {r["dim"]: int(r["value"]) for r in sums.collect()}  # one row for each dimension
    return found.get(0, 0), [found.get(j + 1, 0) for j in range(dims)]


def largest(x: np.ndarray) -> int:
    """The largest magnitude, 1 at least; the least long has none among longs."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)), 1)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, unrounded but for the last division; exact while n * x fits a long."""
    if n * largest(x) < 2**62 and max(map(abs, sums), default=0) < 2**62:
        return (n * x - np.array(sums, np.int64)) / n
    return np.array([[(n * v - s) / n for v, s in zip(row, sums, strict=True)] for row in x.tolist()], np.float64).reshape(x.shape)


def covariance(vectors: DataFrame, dims: int, n: int, sums: list[int]) -> np.ndarray:
    """Mean of the outer products of the centred vectors. Tasks add up whole matrices, which meet row block by row block."""
    blocks = -(-dims // BLOCK)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in slices(batches):
            y = centred(unpacked(batch.column(0).to_pylist(), dims), n, sums)
            total += y.T @ y
        if total.any():
            rows = [total[b * BLOCK : (b + 1) * BLOCK].tobytes() for b in range(blocks)]
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array(rows, pa.binary())], ["block", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[b] = totals.get(b, 0) + np.frombuffer(raw)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["block", "total"])

    out = np.zeros((dims, dims))
    parts = vectors.mapInArrow(products, "block int, total binary").repartition(blocks, "block").mapInArrow(add, "block int, total binary")
    for row in parts.collect():  # dims rows of dims numbers
        out[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["total"]).reshape(-1, dims)
    return (out + out.T) / (2 * max(n, 1))


# -- eigenvectors -----------------------------------------------------------------------------


def eigenvectors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the symmetric matrix ``v``, falling, and unit eigenvectors in the columns, both to double precision."""
    size = float(np.abs(v).max(initial=0))
    if not size:
        return np.zeros(len(v)), np.eye(len(v))
    a = v.astype(WIDE) / WIDE(size)
    _, x = np.linalg.eigh((v / size).astype(np.float32))
    x = x.astype(WIDE)
    last = np.inf
    for _ in range(STEPS):
        x, error = refined(a, x)
        if error == 0 or error < 1e-12 and error >= last / 4:  # no digits more to gain
            break
        last = error
    values = np.einsum("ij,ij->j", x, a @ x) / np.einsum("ij,ij->j", x, x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt(np.einsum("ij,ij->j", x, x))[order]
    return (values[order] * WIDE(size)).astype(np.float64), x.astype(np.float64)


def refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """One step: better eigenvectors of ``a`` and the size of the correction; clusters get a solve of their own."""
    eye = np.eye(len(a), dtype=WIDE)
    r = eye - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2  # rounding that isn't symmetric would grow by one over the gap
    values = np.diag(s) / (1 - np.diag(r))
    norm = lambda m: float(np.abs(m).sum(axis=1).max())  # noqa: E731  at least the spectral norm
    near = 2 * (norm(s - np.diag(values)) + norm(a) * norm(r))
    gap = values[None, :] - values[:, None]
    close = np.abs(gap) <= near
    step = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gap))
    x = x + x @ step
    error = float(np.abs(np.where(close, r, step)).max())
    for group in clusters(values, near):
        x[:, group], turned = solved_inside(a, x[:, group])
        error = max(error, turned)
    return x, error


def clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Groups of two and more columns whose eigenvalues follow one another by at most ``near``."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > near) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def solved_inside(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """The columns of ``x`` turned so that ``a``, less their mean eigenvalue, is diagonal between them.

    The shift leaves the small differences alone, so double precision resolves what a step on the whole matrix cannot.
    """
    low = np.linalg.cholesky((x.T @ x).astype(np.float64)).astype(WIDE)
    x = x @ _lower_inverse(low).T  # orthonormal columns
    inner = x.T @ (a @ x)
    middle = np.trace(inner) / len(inner)
    small = inner - middle * np.eye(len(inner), dtype=WIDE)
    size = np.abs(small).max()
    if not size:
        return x, 0.0
    small = (small + small.T) / (2 * size)
    _, turn = np.linalg.eigh(small.astype(np.float64))
    turned = float(size) * float(np.abs(small - np.diag(np.diag(small))).max())
    return x @ turn.astype(WIDE), turned


def _lower_inverse(low: np.ndarray) -> np.ndarray:
    """Inverse of a lower triangular matrix, a double-precision one corrected once in extended precision."""
    first = np.linalg.inv(low.astype(np.float64)).astype(WIDE)
    return first @ (2 * np.eye(len(low), dtype=WIDE) - low @ first)


# -- whitening --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """What a fit learns; ``axes`` holds a column for each component, 0 where it has no spread."""

    n: int
    sums: list[int]
    axes: np.ndarray
    explained: list[float]
    spread: list[bool]
    identity_error: float | None


def scores(x: np.ndarray, model: Whitening) -> np.ndarray:
    return centred(x, model.n, model.sums) @ model.axes


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the column embedding of ``rows``; none without any usable vector."""
    dims = commonest_length(rows)
    if not dims:
        return None
    vectors = stored(distinct_vectors(rows, dims), "vectors")
    n, sums = exact_sums(vectors, dims)
    v = covariance(vectors, dims, n, sums)
    values, axes = eigenvectors(v)
    values, axes = values[:components], axes[:, :components]
    floor = dims * np.finfo(np.float64).eps * max(float(values.max(initial=0)), 0.0)
    spread = values > floor
    axes = np.where(spread, axes / np.sqrt(np.where(spread, values, 1)), 0)
    model = Whitening(n, sums, axes, [float(e) for e in np.where(spread, values, 0) / max(float(np.trace(v)), 1e-300)], spread.tolist(), None)
    model = Whitening(n, sums, axes, model.explained, model.spread, identity_error(vectors, model, dims))
    emptied(vectors)
    return model


def identity_error(vectors: DataFrame, model: Whitening, dims: int) -> float | None:
    """Largest difference between the covariance of the whitened fit vectors, taken over all of them, and the identity."""
    kept = [i for i, s in enumerate(model.spread) if s]
    if not kept:
        return None
    names = [f"w{i}" for i in kept]

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            w = scores(unpacked(batch.column(0).to_pylist(), dims), model)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in kept], names)

    white = vectors.mapInArrow(whiten, ", ".join(f"{c} double" for c in names))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    found = white.agg(*[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n * x - S) ** 2, exactly; null beyond a long."""
    most = n * largest(x) + max(map(abs, sums), default=0)
    if most * most * x.shape[1] < 2**62:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [e if e < 2**63 else None for e in exact]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """A row for every usable vector and component."""
    if model is None:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    names, dims, k = [c.split()[0] for c in SCHEMA.split(", ")], len(model.sums), len(model.spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept = of_length(batch, dims)
            m = kept.num_rows
            if not m:
                continue
            x = whole(kept.column(0), dims)
            hidden = ~np.tile(model.spread, m)
            each = lambda column: column.take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays(
                [
                    each(kept.column(1)),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, model.n), pa.int64()),
                    each(pa.array(deviations(x, model.n, model.sums), pa.int64())),
                    pa.array(scores(x, model).ravel(), pa.float64(), mask=hidden),
                    pa.array(np.tile(model.explained, m), pa.float64()),
                    pa.array([model.identity_error] * (m * k), pa.float64()),
                ],
                names,
            )

    return rows.select("embedding", F.col("vec_id").cast("long").alias("vec_id")).mapInArrow(run, SCHEMA)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return whitened(rows, fit(rows))
