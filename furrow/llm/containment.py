"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents long, so the similarity of whole sets says nothing. Items of at most SMALLEST shingles are
looked up exactly: a document that has enough of such an item has one of any so many of its shingles as may be missing, and one
more, and each shingle of a document is sought among these. None is missed. The others are partitioned by
their number of shingles into classes that double. For a class of at most u shingles a document is covered by windows of 2u shingles
that start every u, so an item that stands in the document lies whole in one of them, and item and window are of
comparable size: an item has more than half its class's shingles, so one of which eight tenths stand there agrees with its window in each MinHash value with a
chance of 0.19 or more, and in none of 64 values with a chance below 2e-6. Window minima are built from block minima, so each
shingle is hashed once for all classes. Any agreement makes a candidate, which is then verified by exact containment: the share of
the item's distinct shingles that the whole document has.

Items are a stated query set, brought to the documents in blocks of bounded bytes; every document is read once a block.

Null and empty texts contain nothing; an empty item is contained nowhere. An item of fewer words than a shingle is one shingle of
all its words and is sought among the documents' runs of as many words. Repeated items and documents give a row each. Extra
columns aren't read. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import SHINGLE_WORDS, by_text, shingle_hashes, shingles_sql, table, text_or_empty, word_hashes, words_sql
from furrow.llm.pieces import grouped

THRESHOLD = 0.8
HASHES = 64
SMALLEST = 8
BLOCK_BYTES = 4 << 20
#: Bits of a MinHash value that a lookup table of an item class is indexed by.
TABLE_BITS = 14


def _family(n: int) -> np.ndarray:
    return (np.random.default_rng(8).integers(0, 2**32, n, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


_FAMILY = _family(HASHES)


def minima(planes: np.ndarray) -> np.ndarray:
    """(hashes, blocks): minimum of each hash function over each column of (SMALLEST, blocks)."""
    out = np.empty((HASHES, planes.shape[1]), np.uint32)
    for i, a in enumerate(_FAMILY):
        np.min(planes * a, axis=0, out=out[i])
    return out


def fold(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(32))).astype(np.uint32)


class Items:
    """A block of items: their shingle sets, the shingles to look for of small ones, and for each size class of the others the MinHash values."""

    def __init__(self, ids: list, texts: list[str | None], threshold: float = THRESHOLD):
        words, counts = word_hashes(texts)
        self.ids, self.sets, self.width = [], [], []
        for key, w in zip(ids, by_text(words, counts), strict=True):
            if len(w):
                self.ids.append(key)
                self.sets.append(np.unique(shingle_hashes(w)))
                self.width.append(min(len(w), SHINGLE_WORDS))
        self.classes: dict[int, list[tuple[int, list[int], np.ndarray, np.ndarray]]] = {}
        self.small: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, int]] = {}
        groups: dict[tuple[int, int], list[int]] = {}
        keys: dict[int, list[tuple[int, int]]] = {}
        for i, s in enumerate(self.sets):
            if len(s) <= SMALLEST:
                least = next((n for n in range(1, len(s)) if n >= threshold * len(s)), len(s))
                keys.setdefault(self.width[i], []).extend((int(h), i) for h in s[: len(s) - least + 1])
            else:
                groups.setdefault((self.width[i], 1 << (len(s) - 1).bit_length()), []).append(i)
        for width, pairs in keys.items():
            pairs.sort()
            own = np.array([h for h, _ in pairs], np.uint64)
            bits = max(TABLE_BITS, (8 * len(own)).bit_length())
            lookup = np.zeros(1 << bits, bool)
            lookup[(own >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.small[width] = own, np.array([i for _, i in pairs]), lookup, bits
        for (width, size), members in sorted(groups.items()):
            signatures = np.stack([(fold(self.sets[i])[None, :] * _FAMILY[:, None]).min(1) for i in members], axis=1)  # hashes x members
            lookup = np.zeros((HASHES, 1 << TABLE_BITS), bool)
            # small minima are the usual ones, so the table is indexed by mixed bits
            np.put_along_axis(lookup, self.index(signatures), True, axis=1)
            self.classes.setdefault(width, []).append((size, members, signatures, lookup))

    @staticmethod
    def index(values: np.ndarray) -> np.ndarray:
        return ((values * np.uint32(0x9E3779B1)) >> np.uint32(32 - TABLE_BITS)).astype(np.int64)

    def candidates(self, hashes: list[np.ndarray], width: int) -> set[tuple[int, int]]:
        """(document, item) that share a shingle to look for, or agree in a MinHash value of a window of the document."""
        found: set[tuple[int, int]] = set()
        if width in self.small:
            own, members, lookup, bits = self.small[width]
            every = np.concatenate(hashes)
            at = np.flatnonzero(lookup[(every >> np.uint64(64 - bits)).astype(np.int64)])
            low, high = np.searchsorted(own, every[at]), np.searchsorted(own, every[at], side="right")
            docs = np.searchsorted(np.cumsum([len(h) for h in hashes]), at, side="right")
            for k in np.flatnonzero(high > low):
                found.update((int(docs[k]), int(i)) for i in members[low[k] : high[k]])
        if width not in self.classes:
            return found
        classes = self.classes[width]
        align = max(SMALLEST, *(size for size, *_ in classes))  # documents start at multiples of the largest class
        padded = [np.pad(fold(h), (0, -len(h) % align), mode="edge") for h in hashes]
        ends = np.cumsum([len(p) for p in padded]) // SMALLEST
        level, step = minima(np.ascontiguousarray(np.concatenate(padded).reshape(-1, SMALLEST).T)), SMALLEST
        for size, members, signatures, lookup in classes:
            while step < size:  # minima over runs of twice as many shingles
                level, step = np.minimum(level[:, ::2], level[:, 1::2]), 2 * step
            for i in range(HASHES):
                # 2u shingles from each multiple of u; one that reaches into the next document is put right by the verification
                windows = level[i].copy()
                np.minimum(windows[:-1], level[i, 1:], out=windows[:-1])
                at = np.flatnonzero(lookup[i][self.index(windows)])
                if len(at):
                    order = np.argsort(signatures[i])
                    own = signatures[i][order]
                    low, high = np.searchsorted(own, windows[at]), np.searchsorted(own, windows[at], side="right")
                    hit = np.flatnonzero(high > low)
                    docs = np.searchsorted(ends, at[hit] * (size // SMALLEST), side="right")
                    found.update((int(d), members[k]) for d, j in zip(docs, hit, strict=True) for k in order[low[j] : high[j]])
        return found

    def contained(self, texts: list[np.ndarray], threshold: float) -> list[tuple[int, int, int]]:
        """(document, item, shared shingles) of the items that documents, given as word hashes, contain; exactly counted."""
        out = []
        for width in sorted(self.classes.keys() | self.small.keys()):
            long = [d for d, words in enumerate(texts) if len(words) >= width]
            if not long:
                continue
            hashes = [shingle_hashes(texts[d], width) for d in long]
            own: dict[int, np.ndarray] = {}
            for d, i in sorted(self.candidates(hashes, width)):
                if d not in own:
                    own = {d: np.unique(hashes[d])}
                s = self.sets[i]
                shared = int((own[d][np.minimum(np.searchsorted(own[d], s), len(own[d]) - 1)] == s).sum())
                if shared >= threshold * len(s):
                    out.append((long[d], i, shared))
        return out


def blocks_of(items: DataFrame, most: int = BLOCK_BYTES, threshold: float = THRESHOLD) -> Iterator[Items]:
    """The items in blocks of at most ``most`` bytes of text (a longer item alone), one in the driver at a time."""
    ids, texts, held = [], [], 0
    for row in items.select("item_id", text_or_empty().alias("text")).toLocalIterator():
        if held and held + len(row["text"]) > most:
            yield Items(ids, texts, threshold)
            ids, texts, held = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        held += len(row["text"])
    if ids:
        yield Items(ids, texts, threshold)


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles) of every document that has ``threshold`` of an item's shingles or more."""
    return _found(docs, blocks_of(items, threshold=threshold), threshold)


def _found(docs: DataFrame, blocks: Iterable[Items], threshold: float) -> DataFrame:
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, shared long, item_shingles long"

    def search(block: Items) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = sent.value
            for whole in batches:
                for s in grouped(pc.binary_length(whole.column(1)).to_pylist()):
                    batch = whole.slice(s.start, s.stop - s.start)
                    words, counts = word_hashes(batch.column(1).to_pylist())
                    keys = batch.column(0).to_pylist()
                    rows = [(keys[d], known.ids[i], shared, len(known.sets[i])) for d, i, shared in known.contained(by_text(words, counts), threshold)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "shared", "item_shingles"])

        return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, schema)

    found = [search(block) for block in blocks]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no item, with all their columns.

    Each is judged by its text where it is read: only texts go to Python, and nothing is shuffled. Items of several blocks are sought
    block by block, and the documents found, known by their ids and texts, are taken out by a join.
    """
    spark = docs.sparkSession
    blocks = blocks_of(items, threshold=threshold)
    some = list(islice(blocks, 2))
    if not some:
        return docs
    if len(some) == 1:
        sent = spark.sparkContext.broadcast(some[0])

        @F.arrow_udf("boolean")
        def clear(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = sent.value
            for texts in columns:
                keep = np.ones(len(texts), bool)
                for s in grouped(pc.binary_length(texts).to_pylist()):
                    words, counts = word_hashes(texts[s].to_pylist())
                    keep[[s.start + d for d, *_ in known.contained(by_text(words, counts), threshold)]] = False
                yield pa.array(keep)

        return docs.where(clear(text_or_empty()))
    name = F.xxhash64(F.col("doc_id").cast("long"), text_or_empty())
    found = _found(docs.select(name.alias("doc_id"), F.col("text")), chain(some, blocks), threshold)
    hits = found.select(F.col("doc_id").alias("_name")).distinct()
    rows = docs.select(name.alias("_name"), F.struct("*").alias("_row"))
    return rows.join(hits, "_name", "left_anti").select("_row.*")


def op8(spark, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumn("containment", F.col("shared") / F.col("item_shingles"))


def sql() -> str:
    """The same rows by joining all runs of words."""
    return f"""
WITH items AS (
    SELECT row_number() OVER () AS i, item_id, w, least({SHINGLE_WORDS}, len(w)) AS k FROM (SELECT item_id, {words_sql()} AS w FROM benchmark) WHERE len(w) > 0
), item_sets AS (
    SELECT DISTINCT i, item_id, k, unnest({shingles_sql("k")}) AS s FROM items
), sizes AS (
    SELECT i, item_id, count(*) AS n FROM item_sets GROUP BY i, item_id
), docs AS (
    SELECT row_number() OVER () AS d, doc_id, {words_sql()} AS w FROM documents
), doc_sets AS (
    SELECT DISTINCT d, doc_id, k, unnest({shingles_sql("k")}) AS s FROM docs, (SELECT DISTINCT k FROM items) WHERE len(w) >= k
), hits AS (
    SELECT d, doc_id, i, count(*) AS shared FROM doc_sets JOIN item_sets USING (k, s) GROUP BY d, doc_id, i
)
SELECT doc_id, item_id, shared::BIGINT AS shared, n::BIGINT AS item_shingles, shared::DOUBLE / n AS containment FROM hits JOIN sizes USING (i) WHERE shared >= {THRESHOLD} * n
"""
