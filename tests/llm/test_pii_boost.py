import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from furrow.llm import pii_boost
from tests.llm.helpers import AWKWARD, SF, documents

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
TEXTS = ["Write to jo.bo@mail.example.com or +1 (437) 555-0689.", "at 217.75.41.129 and 300.1.1.1", "4981 0215 2537 5367 4012-8888-8888-1881", "Version 2.0.1.3", "no data"]


def plain_base(text):
    """The base patterns as they are stated."""
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


@settings(deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab.@-%+ 12345@é()")), max_size=60))
def test_base_spans(text):
    assert [(pii_boost.KINDS[k], a, b) for k, a, b in pii_boost.base_spans(text)] == plain_base(text)


@pytest.fixture(scope="module")
def model(spark):
    return pii_boost.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_disguised_data_held_out(spark, model):
    """Contexts and data that the fit has not seen."""
    rng = random.Random(77)
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 2000 and not text rlike '[0-9@]'").orderBy("doc_id").limit(150).collect()]
    samples = [(0, "ann.lee@post7.example.org"), (1, "81.12.200.7"), (2, "4012888888881881"), (3, "+1 (437) 555-0689")]
    found = wrong = 0
    for text in texts:
        k, s = rng.choice(samples)
        new = pii_boost.disguised(k, s, rng)
        at = text.find(" ") + 1
        _, more = pii_boost.select(text[:at] + new + " " + text[at:], model)
        found += any(kk == k and a <= at + 1 and b >= at + len(new) - 1 for kk, a, b in more)
        _, none = pii_boost.select(text[:at] + pii_boost.no_data(rng) + " " + text[at:], model)
        wrong += bool(none)
        assert pii_boost.select(text, model) == ([], [])
    assert found >= 0.8 * len(texts)
    assert wrong <= 0.03 * len(texts)


def test_query_keeps_base(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in pii_boost.op2(spark, SF).collect():
        base = plain_base(texts[r["doc_id"]])
        assert set(r["spans"].split(",")) - {""} >= {f"{k}:{a}:{b}" for k, a, b in base}
        assert [r[f"n_{k}"] for k in pii_boost.KINDS] == [sum(x[0] == k for x in base) for k in pii_boost.KINDS]


def test_awkward_rows(spark, model):
    docs = documents(spark, [*AWKWARD, *((40 + i, t) for i, t in enumerate(TEXTS))]).withColumnRenamed("lang", "spans")
    got = pii_boost.redact_documents(docs, model)
    assert got.columns == docs.columns
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[40]["text"] == "Write to <EMAIL> or <PHONE>." and rows[40]["n_chars"] == len(rows[40]["text"])
    assert rows[41]["text"] == "at <IP> and 300.1.1.1" and rows[44]["text"] == "no data" and rows[5]["text"] is None
    assert pii_boost.find(documents(spark, []), model).count() == 0
    assert pii_boost.fit(documents(spark, [])).trees == []


DISGUISED = ["jane at\nexample dot com", "jane [ at ] example.com", "jane{at}example.com", "jane.doe at example.com", "jane <AT> example dot com"]


@pytest.mark.parametrize("address", DISGUISED)
def test_disguised_address_needs_no_digit(address):
    """Every candidate is scored, whatever else stands in the text."""
    eager = pii_boost.Trees(edges=[np.zeros(1)] * pii_boost.FEATURES, trees=[[(-1, 0, 0, 0, 9.0)]], thresholds=[0.5] * 4)
    text = f"Write to {address} today"
    assert pii_boost.candidates(text)
    assert pii_boost.select(text, eager)[1] and pii_boost.select(text + " 7", eager)[1]


@settings(deadline=None)
@given(st.lists(st.sampled_from(["at", "AT", "dot", "jo", "com", " ", "\n", "[", "]", "(", ")", "{", "}", "<", ">", "."]), max_size=14))
def test_texts_without_candidates_alone_are_skipped(words):
    text = "".join(words)
    assert pii_boost._HAS.search(text) or not pii_boost.candidates(text)


def test_long_documents_are_learned_from(spark):
    rng = random.Random(4)
    filler = "some words without any data in them " * 700
    mail = lambda k: f"{filler}Write to jo{k}@mail{k}.example.com or call +1 (437) 555-{rng.randint(1000, 9999)} now. {filler}"
    docs = documents(spark, [(k, mail(k)) for k in range(60)])
    model = pii_boost.fit(docs)
    assert model.trees
    assert len(pii_boost.passage(mail(1), -5)) <= pii_boost.SAMPLE_CHARS and "jo1@mail1.example.com" in pii_boost.passage(mail(1), 2)


def test_overlapping_proposals_hold_the_true_span():
    for text, kind, want in [("order 12 4012888888881881 now", 2, "4012888888881881"), ("437 555 0689 2024", 3, "437 555 0689"), ("7 4012/8888/8888/1881", 2, "4012/8888/8888/1881"), ("1 81.12.200.7", 1, "81.12.200.7")]:
        assert want in {text[a:b] for k, a, b in pii_boost.candidates(text) if k == kind}


def test_long_runs_take_linear_time():
    start = time.time()
    assert pii_boost.base_spans("1" * 1_000_000) == [] and pii_boost.candidates("7" * 200_000) == []
    many = "call 437 555 0689 or 1.2.3.4 and a1@b.cd; " * 20_000
    eager = pii_boost.Trees(edges=[np.zeros(1)] * pii_boost.FEATURES, trees=[[(-1, 0, 0, 0, 5.0)]], thresholds=[0.5] * 4)
    base, more = pii_boost.select(many, eager)
    assert len(base) == 40_000 and len(more) == 20_000
    assert time.time() - start < 60


def test_zeros_in_front_of_an_address_part():
    text = "0" * 301 + ".1.2.3 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 00.0.000.255"
    assert [(k, text[a:b][-12:]) for k, a, b in pii_boost.base_spans(text) if k == 1] == [(1, "000000.1.2.3"), (1, "1.2.3.4"), (1, "5.6.7.8"), (1, "00.0.000.255")]


def test_taken_spans_against_a_plain_list():
    rng = random.Random(4)
    for _ in range(50):
        taken, plain = pii_boost.Taken(), []
        for _ in range(60):
            a = rng.randrange(300)
            b = a + rng.randint(1, 20)
            assert taken.free(a, b) == (not any(a < y and x < b for x, y in plain))
            if rng.random() < 0.5:
                taken.add(a, b)
                plain.append((a, b))


def test_redaction_keeps_columns_of_any_name(spark):
    docs = documents(spark, [(1, "mail ann7@example.org now"), (2, None)]).withColumn("a b", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("spans", F.lit("mine")).withColumn("n_ip", F.lit(5))
    out = pii_boost.redact_documents(docs, pii_boost.Trees())
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[1]["text"] == "mail <EMAIL> now" and (rows[1]["a b"], rows[1]["a.b"], rows[1]["spans"], rows[1]["n_ip"]) == (1, 2, "mine", 5) and rows[2]["text"] is None
