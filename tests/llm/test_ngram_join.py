import random
import re

import numpy as np
import pytest

from furrow.llm import ngram_join
from furrow.llm.components import components
from tests.llm.helpers import AWKWARD, LONG, SF, documents

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows):
    """Set sizes and components by comparing all pairs of sets."""

    def shingles(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    first = {}
    for (key, _), x in zip(rows, label):
        if key is not None:
            first[x] = min(key, first.get(x, key))
    return sorted((repr(key), len(s), repr(first.get(x))) for (key, _), s, x in zip(rows, sets, label))


def got(spark, rows):
    return sorted((repr(a), b, repr(c)) for a, b, c in ngram_join.linked(documents(spark, rows)).collect())


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=60)
    rows = []
    for group in range(12):
        text = rng.choices(words, k=rng.randint(8, 200))
        for _ in range(rng.randint(1, 12)):
            copy = list(text)
            for _ in range(rng.randint(0, 1 + len(copy) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                copy += passage
            rows.append(" ".join(copy).capitalize() if rng.random() < 0.5 else "\n".join(copy))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_copies_against_all_pairs(spark, copies):
    assert got(spark, copies) == brute(copies)


def test_awkward_rows(spark):
    rows = [*AWKWARD, (20, "One  two THREE"), (21, LONG + "end"), (None, None), (22, "one two three four five")]
    assert got(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_keep_one(spark, copies):
    docs = documents(spark, [*copies, copies[0]]).withColumnRenamed("lang", "class")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({int(c) for _, _, c in brute(copies)})


def test_long_chain_of_links(spark):
    chain = spark.range(60).selectExpr("id as a", "id + 1 as b")
    assert {r["label"] for r in components(chain).collect()} == {0}


def test_query_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((repr(a), b, repr(c)) for a, b, c in ngram_join.op10(spark, SF).collect()) == brute(rows)


def test_signatures_differ_in_no_more_bits_than_their_sets():
    rng = np.random.default_rng(4)
    for n in (1, 5, 40, 300, 3000):
        for gone, new in ((0, 0), (n // 9, n // 9), (n // 2, n // 3), (n - 1, 4 * n)):
            a = np.unique(rng.integers(1, 1 << 62, n))
            b = np.unique(np.concatenate([a[gone:], rng.integers(1, 1 << 62, new)]))
            apart = len(np.setxor1d(a, b))
            got = ngram_join.differing(ngram_join.signature(a), ngram_join.signature(b))
            assert got == ngram_join.differing(ngram_join.signature(b), ngram_join.signature(a)) <= apart
            assert (got > 0) == (apart > 0) or apart % 2 == 0


def test_only_sets_of_close_pairs_are_shuffled(spark, monkeypatch):
    """Two sets alike and many others: the parts that pass are those of the two."""
    rng = np.random.default_rng(2)
    sets = {i: np.unique(rng.integers(1, 1 << 62, 200)) for i in range(40)}
    sets[41] = np.unique(np.concatenate([sets[40 - 1][10:], rng.integers(1, 1 << 62, 10)]))
    size = {i: len(s) for i, s in sets.items()}
    parts = spark.createDataFrame([(i, 0, bytearray(s.tobytes())) for i, s in sets.items()], "class long, fragment int, part binary")
    signs = spark.createDataFrame([(i, bytearray(ngram_join.signature(s))) for i, s in sets.items()], "class long, sign binary")
    pairs = spark.createDataFrame([(i, j, size[i], size[j]) for i in sets for j in sets if i < j], "a long, b long, n_a long, n_b long")
    kept = []
    monkeypatch.setattr(ngram_join, "passing", lambda *x, real=ngram_join.passing: kept.append(real(*x).count()) or real(*x))
    found = ngram_join.counted(pairs, parts, signs, 80).collect()
    assert [(r["a"], r["b"], r["shared"]) for r in found] == [(39, 41, len(np.intersect1d(sets[39], sets[41])))]
    assert sum(kept) <= 4


def test_short_signatures_allow_every_similar_pair(spark):
    rng = np.random.default_rng(6)
    rows, expected = [], []
    for i, n in enumerate((1, 9, 90, 900)):
        a = np.unique(rng.integers(1, 1 << 62, n))
        for j, gone in enumerate((0, n // 9, n // 2, n)):
            b = np.unique(np.concatenate([a[gone:], rng.integers(1, 1 << 62, gone)]))
            rows += [(2 * (4 * i + j), bytearray(ngram_join.signature(a)), len(a)), (2 * (4 * i + j) + 1, bytearray(ngram_join.signature(b)), len(b))]
            if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
                expected.append(4 * i + j)
    signs = spark.createDataFrame(rows, "class long, sign binary, n long")
    short = ngram_join.short_signs(signs).join(signs.drop("sign"), "class").selectExpr("*", "class div 2 as pair")
    other = short.where("class % 2 = 1").select("pair", *[short[c].alias(f"other_{c}") for c in ("n", "s0", "s1", "s2", "s3")])
    got = {r["pair"] for r in short.where("class % 2 = 0").join(other, "pair").where(ngram_join.alike(80)).collect()}
    assert got >= set(expected) and 11 not in got  # 90 others of 90
