"""Language network and quality model: held-out accuracy and awkward rows."""

import zlib

import numpy as np

from furrow.llm import language_cnn, quality_gam
from tests.llm.helpers import AWKWARD, documents, write_tables

MIDDLE = "/root/testdata/sf0.1"


def test_languages_held_out(spark):
    rows = language_cnn.op7(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.99 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_training_gradients():
    """A network of few texts separates them."""
    texts, labels = ["abab " * 30, "cdcd " * 30, "abba " * 30, "dccd " * 30] * 20, ["x", "y", "x", "y"] * 20
    net = language_cnn.train(texts, labels)
    windows, owner, _ = language_cnn.cut(["ab ab ab", "cd cd cd"], len(net.tables))
    assert [net.languages[i] for i in net.log_probabilities(windows).argmax(1)] == ["x", "y"]


def test_windows_cover_the_text():
    windows, owner, sizes = language_cnn.cut(["A" * 300, "", "é" * 100], 4)
    assert owner.tolist() == [0, 0, 0, 1, 2, 2] and sizes.tolist() == [128, 128, 44, 1, 128, 72]
    assert windows[0].tobytes() == b"a" * 131 and windows[2].tobytes() == b"a" * 44 + b"\0" * 87


def test_awkward_languages(spark):
    docs = documents(spark, [*AWKWARD, (50, "123 !?")]).withColumnRenamed("source", "score")
    net = language_cnn.train(["the text of it", "le texte de la"] * 5, ["en", "fr"] * 5)
    got = {r["doc_id"]: r for r in language_cnn.predict(docs, net).collect()}
    assert {got[k]["lang_pred"] for k in (5, 3, 4, 50)} == {"und"} and got[1]["lang_pred"] in ("en", "fr")
    assert language_cnn.fit(documents(spark, AWKWARD).select("text", "lang")) is None
    assert {r["lang_pred"] for r in language_cnn.predict(docs, None).collect()} == {"und"}
    assert language_cnn.predict(documents(spark, []), net).count() == 0


def test_quality_held_out(spark):
    rows = quality_gam.op9(spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["quality"] == r["predicted"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_pairs_find_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.train(x, y)
    assert set(model.pairs[0]) == {0, 1}
    assert ((model.scores(x) > 0.5) == y).mean() > 0.9


def test_awkward_quality(spark, tmp_path):
    docs = documents(spark, AWKWARD).withColumnRenamed("source", "features")
    for name, labels in (("none", []), ("some", [(1, 1, 0), (9, 0, 0), (9, None, 0), (2, 1, 0), (77, 1, None)])):
        sf = write_tables(spark, tmp_path / name, documents=docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        rows = quality_gam.op9(spark, sf).collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] == 9}.__len__() == 1
    sf = write_tables(spark, tmp_path / "empty", documents=documents(spark, []), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert quality_gam.op9(spark, sf).count() == 0


def test_order_and_copies_do_not_change_the_fit(spark, monkeypatch):
    """Rows sorted by language, one text a third of all rows: both languages are learned, whatever the order."""
    monkeypatch.setattr(language_cnn, "SAMPLE_ROWS", 200)
    rows = [(f"the text of it number {i}", "en") for i in range(900)] + [("the very same text", "en")] * 600 + [(f"le texte de la page {i}", "fr") for i in range(100)]
    table = spark.createDataFrame(rows, "text string, lang string")
    one, two = language_cnn.fit(table.coalesce(1)), language_cnn.fit(spark.createDataFrame(rows[::-1], table.schema).repartition(7))
    assert one.languages == ["en", "fr"] and np.array_equal(one.tables, two.tables) and np.array_equal(one.out, two.out)
    labelled = spark.createDataFrame([([float(i % 7), float(i)] + [0.0] * 14, int(i >= 900)) for i in range(1000)] + [([9.0] * 16, 0)] * 500, "features array<double>, label int")
    monkeypatch.setattr(quality_gam, "SAMPLE_ROWS", 100)
    a, b = quality_gam.fit(labelled.coalesce(1)), quality_gam.fit(labelled.orderBy("label", "features").repartition(5))
    assert a.base == b.base and np.array_equal(a.tables, b.tables)
    x = np.array([[1.0, 50.0] + [0.0] * 14, [1.0, 980.0] + [0.0] * 14])
    assert a.scores(x)[0] < 0.5 < a.scores(x)[1]


def test_network_against_a_plain_forward_pass(spark):
    net = language_cnn.train(["the text of it", "le texte de la", "der text von"] * 5, ["en", "fr", "de"] * 5)
    texts = ["The le der " * 30, "é x", "a", "Über " * 100]
    got = {r["doc_id"]: r for r in language_cnn.predict(documents(spark, list(enumerate(texts))), net).collect()}
    for k, text in enumerate(texts):
        raw = text.lower().encode()
        sums, total = [0.0] * len(net.languages), 0
        for begin in range(0, len(raw), 128):
            window = raw[begin : begin + 131].ljust(131, b"\0")
            size = min(128, len(raw) - begin)
            pooled = [max(sum(float(net.tables[j][window[i + j]][f]) for j in range(4)) for i in range(128)) for f in range(len(net.bias))]
            z = [sum(max(p + float(net.bias[f]), 0) * float(net.out[f][c]) for f, p in enumerate(pooled)) + float(net.out_bias[c]) for c in range(len(net.languages))]
            log = np.log(sum(np.exp(v) for v in z))
            sums = [s + size * (v - log) for s, v in zip(sums, z, strict=True)]
            total += size
        p = np.exp(np.array(sums) / total)
        p /= p.sum()
        assert got[k]["lang_pred"] == net.languages[int(p.argmax())] and abs(got[k]["score"] - p.max()) < 1e-4


def test_quality_scores_are_sums_of_tables():
    rng = np.random.default_rng(2)
    x = rng.random((600, 4))
    model = quality_gam.train(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float))
    for row, got in list(zip(x, model.scores(x), strict=True))[:40]:
        z = model.base + sum(model.tables[f][sum(e <= row[f] for e in model.edges[f])] for f in range(4))
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            z += t[sum(e <= row[a] for e in model.pair_edges[a])][sum(e <= row[b] for e in model.pair_edges[b])]
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-12
