"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over them, each filter's largest activation in a window is kept, and a softmax layer turns
these into languages. Training is plain numpy with Adam on a bounded sample of labelled texts; tasks then score all texts
in fixed-length windows that cover the whole text, and a document's languages are the mean log probabilities of its
windows weighted by their bytes.

Embedding and filters are linear, so for scoring they are multiplied out to a table of 256 rows for each filter position.

Only text and lang are read for learning, only text for predicting. Null texts and texts without a letter are ``und`` with score 0.
With no labelled text everything is ``und``. Repeated rows get equal answers; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import drawn_apart, table, text_or_empty
from furrow.llm.pieces import grouped

UNKNOWN = "und"
#: Labelled texts that a fit may use, and characters of each: the window starts at a place drawn by the text's hash.
SAMPLE_ROWS, SAMPLE_CHARS = 6000, 400
WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBED = 8
#: Windows that are scored together.
BATCH = 256


@dataclass
class Network:
    """Trained weights; ``tables[j]`` is the filters' response to a byte at position j of their reach."""

    languages: list[str]
    tables: np.ndarray  # reach x 256 x filters
    bias: np.ndarray
    out: np.ndarray  # filters x languages
    out_bias: np.ndarray

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """(windows, languages) for bytes (windows, WINDOW + reach - 1)."""
        length = windows.shape[1] - len(self.tables) + 1
        pooled = []
        for i in range(0, len(windows), BATCH):
            some = windows[i : i + BATCH]
            response = self.tables[0][some[:, :length]]
            for j in range(1, len(self.tables)):
                response += self.tables[j][some[:, j : j + length]]
            pooled.append(response.max(1))
        z = np.maximum(np.concatenate(pooled) + self.bias, 0) @ self.out + self.out_bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def cut(texts: list[str], reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over all texts' lower-cased bytes, the text each belongs to, and its number of bytes. Bytes beyond the text are 0."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    rows = [max(1, -(-len(r) // WINDOW)) for r in raw]
    flat = np.frombuffer(b"".join(r.ljust(n * WINDOW, b"\0") for r, n in zip(raw, rows, strict=True)), np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), rows)
    windows = np.zeros((len(flat), WINDOW + reach - 1), np.uint8)
    windows[:, :WINDOW] = flat
    same = owner[1:] == owner[:-1]
    windows[:-1, WINDOW:][same] = flat[1:, : reach - 1][same]
    first = np.concatenate([[0], np.cumsum(rows)[:-1]])
    place = np.arange(len(flat)) - first[owner]
    sizes = np.minimum(WINDOW, np.array([len(r) for r in raw])[owner] - place * WINDOW)
    return windows, owner, np.maximum(sizes, 1)


def train(texts: list[str], labels: list[str], epochs: int = 8, rate: float = 3e-3, seed: int = 7) -> Network:
    """Adam on cross entropy; gradients of the pooled filters go to the position of each maximum."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    reach = max(WIDTHS)
    windows, owner, _ = cut(texts, reach)
    target = np.array([languages.index(x) for x in labels])[owner]
    n_filters = FILTERS * len(WIDTHS)
    mask = np.zeros((reach, 1, n_filters), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
    w = {
        "embed": rng.normal(0, 0.5, (256, EMBED)),
        "conv": rng.normal(0, 1 / np.sqrt(reach * EMBED), (reach, EMBED, n_filters)) * mask,
        "bias": np.zeros(n_filters),
        "out": rng.normal(0, 1 / np.sqrt(n_filters), (n_filters, len(languages))),
        "out_bias": np.zeros(len(languages)),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // 64)):
            x, y = windows[rows], target[rows]
            response = sum((w["embed"] @ w["conv"][j])[x[:, j : j + WINDOW]] for j in range(reach))
            at = response.argmax(1)  # rows x filters
            pooled = np.take_along_axis(response, at[:, None, :], 1)[:, 0] + w["bias"]
            active = np.maximum(pooled, 0)
            z = active @ w["out"] + w["out_bias"]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ w["out"].T) * (pooled > 0)
            grads = {"out": active.T @ p, "out_bias": p.sum(0), "bias": back.sum(0), "conv": np.zeros_like(w["conv"]), "embed": np.zeros_like(w["embed"])}
            for j in range(reach):
                seen = np.take_along_axis(x, at + j, 1)  # the byte under filter position j at each maximum
                grads["conv"][j] = np.einsum("rfe,rf->ef", w["embed"][seen], back)
                np.add.at(grads["embed"], seen, back[:, :, None] * w["conv"][j].T[None])
            grads["conv"] *= mask
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    tables = np.stack([w["embed"] @ w["conv"][j] for j in range(reach)])
    return Network(languages, tables, w["bias"], w["out"], w["out_bias"])


def fit(labelled: DataFrame) -> Network | None:
    """Train on ``labelled`` (text, lang): a hashed sample of at most SAMPLE_ROWS distinct texts, as many of each language, a part of each."""
    usable = labelled.where("text is not null and lang is not null").select("text", "lang")
    begin = 1 + F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))).cast("int")
    parts = drawn_apart(usable, "lang", ["text"], SAMPLE_ROWS).select(F.substring(F.col("text"), begin, F.lit(SAMPLE_CHARS)).alias("text"), "lang")
    sample = parts.toPandas()
    if not len(sample):
        return None
    sample = sample.sort_values(["lang", "text"])  # the order of rows must not change the weights
    return train(sample["text"].tolist(), sample["lang"].tolist())


def predict(docs: DataFrame, network: Network | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``lang_pred`` and ``score``, the chosen language's probability."""
    kept = docs.select(*keep, text_or_empty().alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]), "lang_pred string, score double"])
    sent = docs.sparkSession.sparkContext.broadcast(network)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for whole in batches:
            for s in grouped(pc.binary_length(whole.column(len(keep))).to_pylist()):
                batch = whole.slice(s.start, s.stop - s.start)
                texts = batch.column(len(keep)).to_pylist()
                known = [i for i, t in enumerate(texts) if net and any(map(str.isalpha, t))]
                names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if known:
                    windows, owner, sizes = cut([texts[i] for i in known], len(net.tables))
                    sums = np.zeros((len(known), len(net.languages)))
                    np.add.at(sums, owner, net.log_probabilities(windows) * sizes[:, None])
                    mean = sums / np.bincount(owner, sizes)[:, None]
                    p = np.exp(mean - mean.max(1, keepdims=True))
                    p /= p.sum(1, keepdims=True)
                    for i, row in zip(known, p, strict=True):
                        names[i], scores[i] = net.languages[int(row.argmax())], float(min(1.0, row.max()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names), pa.array(scores, pa.float64())], [*batch.schema.names[: len(keep)], "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False)))
    network = fit(docs.where("not held_out").select("text", "lang"))
    return predict(docs, network, keep=("doc_id", "held_out"))
