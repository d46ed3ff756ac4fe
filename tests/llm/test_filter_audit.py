"""Filter orders against a walk over every document; the SQL comparison runs with the registered queries."""

import itertools
import re

from pyspark.sql import functions as F

from furrow.llm import filter_audit
from tests.llm.helpers import AWKWARD, documents, write_tables

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failing(rows):
    """The failing filters of every (doc_id, text)."""
    out = []
    for k, t in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": k is not None and any(j is not None and j < k and (u or "") == t for j, u in rows),
        }
        out.append({x for x in bad if bad[x]})
    return out


def walked(rows, parts, good, toxic):
    found = failing(rows)
    out = {}
    for part in set(parts):
        mine = [(f, k) for f, k, p in zip(found, [r[0] for r in rows], parts, strict=True) if p == part]
        totals = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = list(mine)
            for step, x in enumerate(order, 1):
                removed = [d for d in alive if x in d[0]]
                gone = [d for d in mine if d not in alive]
                alive = [d for d in alive if x not in d[0]]
                before = set(order[: step - 1])
                totals[x] += len(removed)
                out[part, "".join(order), step] = [len(alive), len(removed), sum(x in f and bool(f & before) for f, _ in mine), sum(f == {x} for f, _ in mine), sum(k in good for _, k in removed), sum(k in toxic for _, k in removed)]
                assert len(gone) + len(removed) + len(alive) == len(mine)
        for (p, order, step), v in out.items():
            if p == part:
                v.append(totals[order[step - 1]])
    return out


ROWS = [
    *AWKWARD,
    (None, "no key"), (20, "no key"), (21, "no key"), (22, ""), (23, "word " * 300), (24, "word " * 300), (25, " ".join(f"w{i}" for i in range(250))), (26, " ".join(f"w{i}" for i in range(250)) + " SHOUTING LOUD & clear"),
    (27, "x y\u0085z |  end"), (28, " ".join(f"w{i}" for i in range(250)) + " #"), (28, " ".join(f"w{i}" for i in range(250)) + " #"),
]


def test_equals_a_walk_over_documents(spark, tmp_path):
    parts = [("hot", None, "", "b")[i % 4] for i in range(len(ROWS))]
    rows = [(k, t, None, p, None) for (k, t), p in zip(ROWS, parts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("part", F.lit("clash")).withColumn("n", F.lit(7)).withColumn("mask", F.lit("x")).withColumn("a b.c", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (23, 1, None), (24, None, 1), (28, 1, 1), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int").withColumn("part", F.lit(0))
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in FIELDS] for r in filter_audit.op13(spark, write_tables(spark, tmp_path, documents=docs, labels=labels)).collect()}
    want = walked(ROWS, [p or "" for p in parts], {1, 23, 28}, {1, 24, 28})
    assert got == want and len(got) == 3 * 600


def test_without_documents_or_labels(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(documents(spark, []), labels).count() == 0
    rows = filter_audit.audit(documents(spark, [(1, None)]), labels).collect()
    assert len(rows) == 600 and {r["part"] for r in rows} == {""} and all(r["good_lost"] == r["toxic_lost"] == 0 for r in rows)
    assert {r["shapley"] for r in rows if r["filter_order"][r["step"] - 1] == "A"} == {120}  # only too short


def test_the_recursion_has_a_fixed_size(spark):
    walk = filter_audit.steps(spark)
    assert "UnionLoop" in walk._jdf.queryExecution().executedPlan().toString()
    assert walk.count() == 325 * 32
    assert walk.where("step = 5 and mask = 0").select("prefix").distinct().count() == 120
