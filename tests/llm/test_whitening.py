"""Whitening against whole-table numpy; eigenvectors against matrices whose eigenvectors are known exactly."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import whitening
from tests.llm.helpers import SF, write_tables


def brute(rows):
    """(vec_id, deviation, whitened up to sign) of every usable row, in double precision throughout."""
    usable = [(k, v) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(256 * c) for c in v] for _, v in usable], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    y = (n * fit - sums) / n
    v = y.T @ y / n
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values)[:4]
    white = (n * x - sums) / n @ axes[:, order] / np.sqrt(values[order])
    deviation = [sum(int(d) ** 2 for d in row) for row in n * x - sums]
    return n, [k for k, _ in usable], deviation, white, values[order] / np.trace(v)


def compared(got, rows):
    n, keys, deviation, white, explained = brute(rows)
    k = white.shape[1]
    assert len(got) == len(keys) * k and {r["n"] for r in got} == {n}
    by = sorted(((repr(r["vec_id"]), r["deviation"], r["component"], r["whitened"], r["explained"]) for r in got), key=lambda r: (r[2], r[0], r[1]))
    want = sorted(zip(map(repr, keys), deviation, range(len(keys)), strict=True))
    for c in range(k):
        mine = by[c * len(keys) : (c + 1) * len(keys)]
        assert [(r[0], r[1], r[2]) for r in mine] == [(a, b, c + 1) for a, b, _ in want]
        ours, theirs = np.array([r[3] for r in mine]), np.array([white[i, c] for _, _, i in want])
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-8
        assert all(abs(r[4] - explained[c]) < 1e-9 for r in mine)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10


def test_given_vectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compared(whitening.op12(spark, SF).collect(), rows)


def test_awkward_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    plain = [[float(c) for c in v] for v in rng.normal(size=(40, 6)) * [4, 3, 2, 1, 0.5, 0.1]]
    hot = plain[0]
    rows = [*enumerate(plain), *[(100 + i, hot) for i in range(60)], (None, plain[1]), (None, plain[1]), (7, None), (8, []), (9, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (10, [math.nan, *hot[1:]]), (11, [1.0, math.inf, *hot[2:]])]
    rows.append((12, [0.001, -0.001, 0.0, -0.0, 1e5, -1e5]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("component", F.lit("x")).withColumn("a b", F.lit(1)).withColumn("x", F.lit(2))
    folder = write_tables(spark, tmp_path / "a", embeddings=df)
    compared(whitening.op12(spark, folder).collect(), rows)
    # vectors of another length are left out, the commonest decides
    more = df.unionByName(spark.createDataFrame([(77, [1.0, 2.0])], "vec_id long, embedding array<double>"), allowMissingColumns=True)
    assert not [r for r in whitening.whitened(more, whitening.fit(more)).collect() if r["vec_id"] == 77]


def test_no_spread_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    empty = spark.createDataFrame([(1, None), (2, [None])], schema)
    assert whitening.whitened(empty, whitening.fit(empty)).count() == 0
    assert whitening.whitened(empty.limit(0), whitening.fit(empty.limit(0))).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)
    rows = whitening.whitened(one, whitening.fit(one)).collect()
    assert len(rows) == 4 and all((r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, 0.0, None) for r in rows)
    line = spark.createDataFrame([(i, [float(i), 5.0]) for i in range(4)], schema)  # one constant dimension
    rows = sorted((r for r in whitening.whitened(line, whitening.fit(line)).collect()), key=lambda r: (r["component"], r["vec_id"]))
    assert [abs(r["whitened"]) for r in rows[:4]] == pytest.approx([1.5 / math.sqrt(1.25), 0.5 / math.sqrt(1.25)] * 1 + [0.5 / math.sqrt(1.25), 1.5 / math.sqrt(1.25)])
    assert all(r["whitened"] is None for r in rows[4:]) and rows[0]["explained"] == 1.0


def test_entries_out_of_range(spark):
    df = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [0.0, 3.0])], "vec_id long, embedding array<double>")
    rows = whitening.whitened(df, whitening.fit(df)).collect()
    assert len(rows) == 6 and {r["deviation"] for r in rows if r["vec_id"] < 3} == {None} and all(math.isfinite(r["whitened"]) for r in rows if r["component"] == 1)


def test_sums_are_exact(spark):
    big = [[2.0**53, -(2.0**54)], [2.0**53 + 2, 2.0**54 - 4], [1.0, 3.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(big)], "vec_id long, embedding array<double>")
    assert whitening.exact_sums(whitening.distinct_vectors(df, 2), 2) == (3, [sum(int(v[j]) * 256 for v in big) for j in range(2)])


@pytest.mark.parametrize("values", [[8, 4, 2, 1], [1 + 2**-30, 1 + 2**-31, 1, 0.5], [1 + 2**-44, 1 - 2**-44, 2**-20, 2**-21], [3, 3, 1, 0]])
def test_known_eigenvectors(values):
    """A reflection with entries of halves: eigenvectors and matrix are exact numbers."""
    h = np.eye(4) - np.ones((4, 4)) / 2
    a = h @ np.diag(np.array(values, float)) @ h
    got, x = whitening.eigenvectors(a)
    assert np.abs(got - sorted(values, reverse=True)).max() < 4e-16 * max(values)
    assert np.abs(x.T @ x - np.eye(4)).max() < 5e-16
    for j, v in enumerate(values):
        same = [i for i, u in enumerate(values) if u == v]
        inside = h[:, same] @ (h[:, same].T @ x[:, j])  # the part of the vector in its own space
        gap = min(abs(u - v) for u in values if u != v) / max(values)
        assert np.abs(inside - x[:, j]).max() < max(1e-15, 4e-19 / gap)  # extended precision holds 19 digits


def test_clusters_in_a_large_matrix():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(60, 60)))
    values = np.concatenate([np.full(5, 10.0) + np.arange(5) * 1e-9, np.full(20, 1.0) + np.arange(20) * 1e-11, rng.uniform(0, 1, 35)])
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    got, x = whitening.eigenvectors(a)
    assert (np.diff(got) <= 0).all() and np.abs(got - np.sort(values)[::-1]).max() < 1e-13
    assert np.abs(a @ x - x * got).max() < 1e-14 * 10 and np.abs(x.T @ x - np.eye(60)).max() < 1e-14
