import hashlib


from pyspark.sql import functions as F

import corpus_pipeline
from furrow.llm import pii_boost, quality_rules
from tests.llm.helpers import AWKWARD, SF, documents, write_tables
from tests.llm.test_bpe_segments import LIBRARY
from tests.llm.test_containment import brute as contained
from tests.llm.test_ngram_join import brute as linked


def test_stages_against_brute_force(spark):
    """Each stage on its own input, and the whole run."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality rules"](spark, docs, SF).cache()
    assert good.columns == columns
    kept = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept

    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    single = stages["near copies"](spark, good, SF).cache()
    assert single.columns == columns
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({int(c) for _, _, c in linked(rows)})

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [(r["doc_id"], r["text"]) for r in single.collect()]
    clean = stages["decontamination"](spark, single, SF).cache()
    leaks = {key for key, *_ in contained(rows, items)}
    assert clean.columns == columns
    assert {r["doc_id"] for r in clean.collect()} == {key for key, _ in rows} - leaks

    redacted = stages["personal data"](spark, clean, SF).cache()
    assert redacted.columns == columns
    texts = {r["doc_id"]: r["text"] for r in redacted.collect()}
    for r in clean.collect():
        base = pii_boost.base_spans(r["text"])
        assert not pii_boost.base_spans(texts[r["doc_id"]])
        assert base or r["text"] == texts[r["doc_id"]]

    coded = stages["encoding"](spark, redacted, SF).collect()
    assert len(coded) == len(texts)
    for r in coded:
        assert list(r["ids"]) == LIBRARY.encode_ordinary(texts[r["doc_id"]])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in whole.collect()) == sorted((r["doc_id"], r["ids_sha256"]) for r in coded)


def test_awkward_tables(spark, tmp_path):
    more = [(30, "The first of the documents that is long enough to stay in the corpus for good."), (30, "The first of the documents that is long enough to stay in the corpus for good."), (None, "and a text without an id that is long enough to stay here for the test of it")]
    for name, rows in (("awkward", AWKWARD + more), ("empty", [])):
        docs = documents(spark, rows)
        for other in ("a b", "a.b", "ids", "n_tokens", "label", "_row", "fp", "spans"):
            docs = docs.withColumn(other, F.lit(f"my {other}"))
        sf = write_tables(spark, tmp_path / name, documents=docs, benchmark=spark.createDataFrame([(1, None), (2, "")], "item_id long, text string"))
        got = corpus_pipeline.run(spark, sf).collect()
        # 7 has eleven words, too few for the rule on function words, and breaks no other rule
        assert sorted(repr(r["doc_id"]) for r in got) == ([] if not rows else ["30", "7", "None"])
        assert all((r["a b"], r["a.b"], r["label"], r["_row"], r["spans"]) == ("my a b", "my a.b", "my label", "my _row", "my spans") and len(r["ids"]) == r["n_tokens"] for r in got)
