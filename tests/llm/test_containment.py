import random
import re

from furrow.llm import containment
from furrow.llm.common import by_text, word_hashes
from tests.llm.helpers import AWKWARD, LONG, SF, documents

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]


def runs(w, n):
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items):
    out = []
    for key, text in docs:
        w = words(text)
        for item, t in items:
            own = words(t)
            n = min(5, len(own))
            if n:
                s = runs(own, n)
                shared = len(s & runs(w, n))
                if shared >= 0.8 * len(s):
                    out.append((key, item, shared, len(s)))
    return sorted(out, key=repr)


def items_table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_planted_passages(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 9, 14, 40, 60, 300])))) for i in range(60)]
    docs = []
    for key in range(150):
        w = rng.choices(vocabulary, k=rng.choice([20, 100, 700, 3000]))
        if key % 2:
            passage = rng.choice(items)[1].upper().split()
            if rng.random() < 0.6 and len(passage) > 30:
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(w))
            w[at:at] = passage
        docs.append((key, rng.choice([" ", "\n"]).join(w)))
    found = containment.contained(documents(spark, docs), items_table(spark, items))
    want = brute(docs, items)
    assert len(want) > 60
    assert sorted(map(tuple, found.collect()), key=repr) == want


def test_awkward_rows(spark):
    items = [(1, None), (2, ""), (3, "two THREE"), (4, LONG), (4, "no key"), (None, "and a few more the long text of many words")]
    docs = documents(spark, AWKWARD).withColumnRenamed("lang", "item_id")
    assert sorted(map(tuple, containment.contained(docs, items_table(spark, items)).collect()), key=repr) == brute(AWKWARD, items)
    kept = containment.clean(docs, items_table(spark, items))
    assert kept.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(k) for k, t in AWKWARD if not brute([(k, t)], items))


def test_empty_tables(spark):
    none = items_table(spark, [])
    assert containment.contained(documents(spark, AWKWARD), none).count() == 0
    assert containment.clean(documents(spark, AWKWARD), none).count() == len(AWKWARD)
    assert containment.contained(documents(spark, []), items_table(spark, [(1, "a b c d e f")])).count() == 0


def test_blocks_of_items(spark):
    items = [(i, f"alpha beta gamma delta epsilon zeta {i}") for i in range(20)]
    assert len(list(containment.blocks_of(items_table(spark, items), most=100))) > 5


def test_query_against_exact_containment(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = containment.op8(spark, SF).drop("containment").collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items)


def test_short_items_that_stand_once_in_long_texts():
    """About 0.4 % of single occurrences of one shingle were missed by the windows' minima alone."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(400)) for _ in range(30)]
    items, want = [], set()
    for d, text in enumerate(texts):
        w = text.split()
        for at in range(0, 380, 4):
            n = (1, 3, 5, 6, 8, 9, 12)[len(items) % 7]
            passage = w[at : at + n]
            if n == 9:  # five shingles, of which four are there
                passage = [*passage[:-1], "changed"]
            want.add((d, len(items)))
            items.append(" ".join(passage))
    known = containment.Items(list(range(len(items))), items)
    words, counts = word_hashes(texts)
    found = known.contained(by_text(words, counts), 0.8)
    assert {(d, known.ids[i]) for d, i, _ in found} == want
    assert containment.Items([1], ["a b c d e f"], 0.5).contained(by_text(*word_hashes(["x a b c d e y", "b c d e f"])), 0.5) == [(0, 0, 1), (1, 0, 1)]


def test_texts_stay_where_they_are_read(spark):
    items = [(1, "a stated query of six words"), (2, "another one that is sought")]
    docs = documents(spark, [(i, f"document {i} with {'a stated query of six words' if i % 3 == 0 else 'nothing'} in it") for i in range(30)] + [(None, None), (None, items[1][1])])
    kept = containment.clean(docs.repartition(3), items_table(spark, items))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Repartition") == 1
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted([repr(i) for i in range(30) if i % 3] + ["None"])


def test_items_of_several_blocks(spark, monkeypatch):
    items = [(i, f"item number {i} of {i} words") for i in range(6)]
    docs = documents(spark, [(i, f"here is item number {i} of {i} words again") for i in range(9)] + [(None, "no id"), (None, items[5][1])])
    one = containment.clean(docs, items_table(spark, items)).collect()
    blocks = containment.blocks_of
    monkeypatch.setattr(containment, "blocks_of", lambda items, threshold: blocks(items, 40, threshold))
    assert containment.clean(docs, items_table(spark, items).coalesce(1))._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") > 2
    several = containment.clean(docs, items_table(spark, items)).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, several)) and {r["doc_id"] for r in one} == {6, 7, 8, None}
