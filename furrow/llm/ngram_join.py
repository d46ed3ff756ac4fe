"""N-gram Jaccard join by vertical partitioning.

All word shingles get one global order: rare ones first, equal ones by hash. It is cut into fragments of equal
mass. The overlap of two documents is counted separately in every fragment and summed per pair.

Which pairs are counted follows from the order. Of two sets whose similarity reaches the threshold t, the prefixes of
``n - ceil(t n) + l`` shingles share at least the smaller l of the two, so only these prefixes meet, in a list for each shingle, and
only pairs that meet so often are counted, or as often as their two sizes ask for, which is more where the sizes are alike. l grows with
n (a twentieth of it): passages that documents have in common don't make a pair. Documents with equal sets are one class and take part once.

The lists are worked off in rounds, in which pairs of one component are left out. In a star round every class is compared with one
other, in later rounds with a few, those it meets most often of the ones that hashes picked from its lists; rounds with other hashes go on
while they still join components. So a group of near copies costs about as many counts as members. Lists that hold one component alone are done with.
At last all pairs of a list that lie in different components are counted: a list's commonest component isn't compared with
itself, however large, and no link between components can be missed.

Shingles are 64-bit hashes of which 55 bits are kept, beside 8 bits of their frequency level; a false match within a pair of
documents of a thousand shingles has a chance of about 3e-11.

Null and empty texts have no shingles, link with nothing and keep their own id. Fewer than five words are one
shingle. A null id is no component's id while another id is in it. Repeated rows are copies. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import SHINGLE_WORDS, SPACE, by_text, emptied, mixed, shingle_hashes, shingles_sql, stored, table, text_or_empty, word_hashes, words_sql
from furrow.llm.components import components
from furrow.llm.pieces import grouped

PERCENT = 80
FRAGMENTS = 8
#: Buckets of the frequency sketch and counts in a row of it: the sketch's size doesn't depend on the data.
BUCKET_BITS, BLOCK_BITS = 18, 12
#: Bits of a shingle below its frequency level, and levels in an octave of frequency.
HASH_BITS, LEVEL_STEPS = 55, 4
#: One more shared shingle is asked for with each so many shingles of a set.
SHARED_EACH = 20
#: Bits of the filter that names classes with partners: 16 for each class, at most 8 MB. A full filter passes everything.
FILTER_BITS_EACH, FILTER_BITS_MOST = 16, 1 << 26
#: Bits of a set's signature for each shingle, at least, the most bits, and the least in 64-bit numbers.
SIGN_BITS_EACH, SIGN_BITS_MOST, SIGN_LONGS = 2, 1 << 16, 4
#: Star rounds go on while a round joins more than one in so many of the classes it compared.
WORTH = 50
#: Others that a class is counted with in a star round at most.
CENTRES = 16


def text_shingles(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of batches with the shingle hashes of their texts, repeats included."""
    for whole in batches:
        for s in grouped(pc.binary_length(whole.column(column)).to_pylist()):
            batch = whole.slice(s.start, s.stop - s.start)
            words, counts = word_hashes(batch.column(column).to_pylist())
            yield batch, [shingle_hashes(w) for w in by_text(words, counts)]


# -- the global order -------------------------------------------------------------------------


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def sketch(docs: DataFrame) -> np.ndarray:
    """How many documents' shingles fall in each bucket, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for _, sets in text_shingles(batches, 0):
            total += np.bincount(bucket(np.concatenate([np.unique(s) for s in sets])), minlength=len(total))
        rows = total.reshape(-1, 1 << BLOCK_BITS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([r.tobytes() for r in rows])], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[block] = sums.get(block, 0) + np.frombuffer(raw, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()])], ["block", "counts"])

    blocks = docs.select(text_or_empty().alias("text")).mapInArrow(count, "block int, counts binary")
    out = np.zeros((1 << BUCKET_BITS - BLOCK_BITS, 1 << BLOCK_BITS), np.int64)
    for row in blocks.repartition(out.shape[0], "block").mapInArrow(add, "block int, counts binary").collect():  # as many rows as blocks
        out[row["block"]] = np.frombuffer(row["counts"], np.int64)
    return out.ravel()


def levels(counts: np.ndarray) -> np.ndarray:
    """Frequency level of each bucket, some to an octave."""
    return np.minimum(255, np.floor(LEVEL_STEPS * np.log2(counts + 1))).astype(np.uint8)


def ordered(h: np.ndarray, level: np.ndarray) -> np.ndarray:
    """A text's set in the global order, as positive numbers whose size is the order."""
    return np.unique(level[bucket(h)].astype(np.uint64) << np.uint64(HASH_BITS) | (mixed(h) >> np.uint64(64 - HASH_BITS))).astype(np.int64)


def fragment_bounds(counts: np.ndarray, level: np.ndarray, fragments: int) -> np.ndarray:
    """Cuts of the global order into fragments of about equal mass: inside a level the hashes are spread evenly."""
    mass = np.bincount(level.astype(np.int64), counts.astype(float), minlength=256)
    share = np.concatenate([[0], np.cumsum(mass)]) / max(mass.sum(), 1)
    at = np.interp(np.arange(1, fragments) / fragments, share, np.arange(257))
    return np.minimum(at * 2.0**HASH_BITS, 2.0**62.9).astype(np.int64)


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + 1 + n // SHARED_EACH)


# -- passes over the texts --------------------------------------------------------------------


def _keys(s: np.ndarray) -> tuple[int, int]:
    """128-bit name of a set."""
    u = mixed(s.astype(np.uint64))
    return int(u.sum(dtype=np.uint64).astype(np.int64)), int(mixed(u ^ np.uint64(len(u))).sum(dtype=np.uint64).astype(np.int64))


def signature(s: np.ndarray) -> bytes:
    """Parities of how many shingles fall on each bit: two sets differ in at least as many shingles as their signatures in bits."""
    size = min(SIGN_BITS_MOST, 1 << max((64 * SIGN_LONGS - 1).bit_length(), (SIGN_BITS_EACH * len(s) - 1).bit_length()))
    return np.packbits(np.bincount((mixed(s.astype(np.uint64)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """In how many bits two signatures differ; the longer one is folded to the other's length."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) != len(y):
        longer, y = (x, y) if len(x) > len(y) else (y, x)
        x = np.bitwise_xor.reduce(longer.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def profiles(docs: DataFrame, level: np.ndarray, percent: int) -> DataFrame:
    """Row number, id, name of the text, set size, set name and prefix of every document; a task gives the prefix of equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, seen = TaskContext.get().partitionId() << 33, set()
        for batch, hashes in text_shingles(batches, 1):
            sets = [ordered(h, level) for h in hashes]
            names = [_keys(s) for s in sets]
            prefixes = []
            for s, name in zip(sets, names, strict=True):
                prefixes.append(None if name in seen or not len(s) else s[: prefix_length(len(s), percent)])
                seen.add(name)
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + n), pa.int64()), batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in names], pa.int64()), pa.array([k[1] for k in names], pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["row", "doc_id", "t", "n", "k1", "k2", "prefix"],
            )
            row += n

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("t", text_name("text"))
    return read.mapInArrow(run, "row long, doc_id long, t long, n long, k1 long, k2 long, prefix array<long>")


def text_name(column: str = "text"):
    """A 64-bit name of a text; nulls count as empty."""
    return F.xxhash64(text_or_empty(column))


def segments(docs: DataFrame, level: np.ndarray, bounds: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """The fragments' parts of the sets whose names pass the filter ``wanted``, and as fragment -1 their signatures."""
    bits = np.uint64(len(wanted) * 8 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for _, hashes in text_shingles(batches, 0):
            out: list[list] = [[], [], [], []]
            for h in hashes:
                s = ordered(h, level)
                name = _keys(s)
                if not len(s) or name in seen or not _in_filter(wanted, bits, name[0]):
                    continue
                seen.add(name)
                for column, value in zip(out, (*name, -1, signature(s)), strict=True):
                    column.append(value)
                cuts = [0, *np.searchsorted(s, bounds).tolist(), len(s)]
                for f in range(len(cuts) - 1):
                    if cuts[f] < cuts[f + 1]:
                        for column, value in zip(out, (*name, f, s[cuts[f] : cuts[f + 1]].tobytes()), strict=True):
                            column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], ["k1", "k2", "fragment", "part"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "k1 long, k2 long, fragment int, part binary")


# -- the filter of classes that have partners -------------------------------------------------


def _filter_bits(name: np.ndarray, bits: np.uint64) -> list[np.ndarray]:
    a = mixed(name.view(np.uint64) if name.dtype == np.int64 else name)
    b = mixed(a + np.uint64(1))
    return [(a + np.uint64(i) * b) & bits for i in range(4)]


def _in_filter(wanted: np.ndarray, bits: np.uint64, name: int) -> bool:
    return all(wanted[int(at[0]) >> 3] >> (int(at[0]) & 7) & 1 for at in _filter_bits(np.array([name], np.int64), bits))


def passing(df: DataFrame, column: str, wanted: np.ndarray) -> DataFrame:
    """The rows of ``df`` whose ``column`` (long) may be in the filter ``wanted``."""
    bits, at = np.uint64(len(wanted) * 8 - 1), df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = np.array(batch.column(at).to_numpy(zero_copy_only=False), np.int64)
            hit = np.logical_and.reduce([(wanted[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 for x in _filter_bits(name, bits)])
            yield batch.filter(pa.array(hit))

    return df.mapInArrow(run, df.schema)


def name_filter(names: DataFrame) -> np.ndarray:
    """A Bloom filter of the column k1. Tasks build filters of one size, which are joined bytewise in a tree."""
    n = names.count()
    size = min(FILTER_BITS_MOST, 1 << max(13, (FILTER_BITS_EACH * n).bit_length())) // 8
    bits, block = np.uint64(size * 8 - 1), min(size, 1 << 16)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.uint8)
        for batch in batches:
            for at in _filter_bits(np.array(batch.column(0).to_numpy(zero_copy_only=False), np.int64), bits):
                np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        rows = [(i, own[i : i + block].tobytes()) for i in range(0, size, block) if own[i : i + block].any()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["at", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[at] = sums.get(at, np.uint8(0)) | np.frombuffer(raw, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["at", "bits"])

    out = np.zeros(size, np.uint8)
    for row in names.select("k1").mapInArrow(build, "at long, bits binary").repartition(max(1, size // block), "at").mapInArrow(merge, "at long, bits binary").collect():  # FILTER_BITS_MOST at most
        out[row["at"] : row["at"] + block] = np.frombuffer(row["bits"], np.uint8)
    return out


# -- rounds -----------------------------------------------------------------------------------


def possible(percent: int):
    """Columns n, p and other_n, other_p: sizes and positions allow the similarity."""
    ours, other = F.col("n"), F.col("other_n")
    most = F.least("p", "other_p") + 1 + F.least(ours - F.col("p") - 1, other - F.col("other_p") - 1)
    return (100 * F.least(ours, other) >= percent * F.greatest(ours, other)) & ((100 + percent) * most >= percent * (ours + other))


def near(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b) that may reach the similarity by their signatures; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            apart = np.array([differing(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            keep = (100 + percent) * ((sizes - apart) // 2) >= percent * sizes
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:4]], ["a", "b", "n_a", "n_b"])

    left, right = signs.select(F.col("class").alias("a"), F.col("sign").alias("sign_a")), signs.select(F.col("class").alias("b"), F.col("sign").alias("sign_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "sign_a", "sign_b")
    return stored(both.mapInArrow(run, "a long, b long, n_a long, n_b long"), "near")


def short_signs(signs: DataFrame) -> DataFrame:
    """class and its signature folded to the least bits, as numbers s0, s1, ..."""
    names = [f"s{i}" for i in range(SIGN_LONGS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                short = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.int64).reshape(-1, SIGN_LONGS), axis=0) for x in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(x)) for x in short.T]], ["class", *names])

    return signs.select("class", "sign").mapInArrow(run, ", ".join(["class long", *[f"{x} long" for x in names]]))


def alike(percent: int):
    """Columns n, other_n and short signatures allow the similarity: shared shingles are at most half of what the sizes exceed the differing bits by."""
    both = F.col("n") + F.col("other_n")
    apart = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.col(f"other_s{i}"))) for i in range(SIGN_LONGS)), F.lit(0))
    return (100 + percent) * (both - apart) >= 2 * percent * both


def counted(pairs: DataFrame, parts: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, shared) that reach the similarity; stored. Overlaps are counted in each fragment and summed, for pairs that signatures leave.

    Only the parts of these pairs' sets are shuffled.
    """

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
            shared = [len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True)) for x, y in both]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shared, pa.int64())], ["a", "b", "n_a", "n_b", "shared"])

    close = near(pairs, signs, percent)
    a, b = (passing(parts, "class", name_filter(close.select(F.col(x).alias("k1")).distinct())) for x in "ab")
    left, right = a.select(F.col("class").alias("a"), "fragment", F.col("part").alias("part_a")), b.select(F.col("class").alias("b"), "fragment", F.col("part").alias("part_b"))
    met = close.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "n_a", "n_b", "part_a", "part_b")
    sums = met.mapInArrow(overlaps, "a long, b long, n_a long, n_b long, shared long").groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))
    found = stored(sums.where((100 + percent) * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b", "shared"), "found")
    emptied(close)
    return found


def _pairs(df: DataFrame) -> DataFrame:
    """Pairs with the smaller class first, each once, with the number of lists they met in."""
    low = F.col("class") < F.col("other")
    pick = lambda x, y: F.when(low, F.col(x)).otherwise(F.col(y))
    return df.groupBy(pick("class", "other").alias("a"), pick("other", "class").alias("b"), pick("n", "other_n").alias("n_a"), pick("other_n", "n").alias("n_b")).agg(F.count("*").alias("met"))


def star(lists: DataFrame, percent: int, turn: int) -> DataFrame:
    """Every class with those of its lists' centres that it meets most often: one in the first turn, more in later ones.

    The centres are of the list's commonest component, the members with the least hashes: what has not joined a large group
    yet meets others of its members in every turn.
    """
    tries = min(CENTRES, 4**turn)
    order = F.struct("k", F.xxhash64("label", F.lit(turn)).alias("hash"))
    common = lists.groupBy("h", "label").agg(F.count("*").alias("k")).groupBy("h").agg(F.max_by("label", order).alias("common"))
    marked = lists.join(common, "h")
    drawn = F.row_number().over(Window.partitionBy("h").orderBy(F.xxhash64("class", F.lit(turn)), "class"))
    centres = marked.where("label = common").select("h", F.col("class").alias("other"), F.col("n").alias("other_n"), F.col("p").alias("other_p"), drawn.alias("drawn"))
    met = marked.where("label <> common").join(centres.where(F.col("drawn") <= tries).drop("drawn"), "h").where(possible(percent))
    counts = met.groupBy("class", "n", "other", "other_n").count()
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("count"), "other"))
    return _pairs(counts.withColumn("place", place).where(F.col("place") <= tries).select("class", "n", "other", "other_n")).drop("met")


def leftovers(lists: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """All pairs of a list that lie in different components and meet as often as they must.

    At least one of such a pair isn't of the list's commonest component: those classes look for their others, so a component that
    fills a list meets only the few that are left. Lists have an order too, short ones first. A pair is taken up only in a list that may be
    the first it meets in: either class has so many lists from there on as the pair must share. That leaves the head of each class's lists, where pairs are taken up
    whose signatures allow it.
    """
    sizes = lists.groupBy("h", "label").agg(F.count("*").alias("k")).groupBy("h").agg(F.max_by("label", F.struct("k", "label")).alias("common"), F.sum("k").alias("size"))
    own = Window.partitionBy("class").orderBy(F.desc("size"), F.desc("h"))  # a class's lists are no more than its prefix
    marked = lists.join(sizes, "h").withColumn("rare", F.col("label") != F.col("common")).withColumn("rest", F.row_number().over(own))
    heads = marked.where(F.col("rest") >= fewest_met(percent)).drop("common", "size").join(short_signs(signs), "class")
    other = heads.select("h", *[F.col(c).alias(f"other_{c}") for c in ("class", "n", "p", "label", "rare", "rest", *[f"s{i}" for i in range(SIGN_LONGS)])]).withColumnRenamed("other_class", "other")
    once = ~F.col("other_rare") | (F.col("class") < F.col("other"))
    first = F.least("rest", "other_rest") >= least_met(percent, "n", "other_n")
    met = _pairs(heads.where("rare").join(other, "h").where((F.col("label") != F.col("other_label")) & once & first & possible(percent) & alike(percent))).drop("met")
    whole = lists.groupBy("class").agg(F.collect_list("h").alias("hs"))
    left, right = whole.select(F.col("class").alias("a"), F.col("hs").alias("hs_a")), whole.select(F.col("class").alias("b"), F.col("hs").alias("hs_b"))
    shared = F.size(F.array_intersect("hs_a", "hs_b"))
    return met.join(left, "a").join(right, "b").where(shared >= least_met(percent, "n_a", "n_b")).select("a", "b", "n_a", "n_b")


def least_met(percent: int, a: str, b: str):
    """In how many lists a similar pair of sizes ``a`` and ``b`` meets at least.

    It shares some number of shingles at least, so each set misses few of the other's. Of the prefix that ends first in the global
    order, every shingle that the other set has lies in the other prefix too: all of it but those few.
    """

    def kept(n: str):  # what the prefix is longer than the rest by which the set may exceed the overlap
        return F.least(F.col(n), F.col(n) - F.ceil(F.col(n) * percent / 100) + 1 + F.floor(F.col(n) / SHARED_EACH)) - F.col(n)

    overlap = F.ceil((F.col(a) + F.col(b)) * percent / (100 + percent))
    return F.greatest(1 + F.floor(F.least(a, b) / SHARED_EACH), F.least(kept(a), kept(b)) + overlap)


def fewest_met(percent: int):
    """In how many lists a class of size n meets any partner at least: it has at least the share of n of its shingles."""
    return 1 + F.floor(F.ceil(F.col("n") * percent / 100) / SHARED_EACH)


def open_lists(lists: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """The lists that hold more than one component, of classes with enough of them to have a partner there, with their labels; stored."""
    marked = lists.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    mixed_ones = marked.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("h")
    return stored(often(marked.join(mixed_ones, "h", "left_semi").select("h", "class", "n", "p", "label"), percent), "open")


def often(lists: DataFrame, percent: int) -> DataFrame:
    """The rows of classes in so many lists that they may have a partner: it has at least the share of their shingles, and they meet it so often."""
    of_class = F.count("*").over(Window.partitionBy("class"))  # a class's lists are no more than its prefix
    return lists.withColumn("lists", of_class).where(F.col("lists") >= fewest_met(percent)).drop("lists")


def class_lists(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(h, class, n, p): the classes whose prefixes share a shingle with others often enough to have a partner; stored."""
    postings = rows.where("prefix is not null").select("row", F.posexplode("prefix").alias("p", "h"))
    several = stored(postings.groupBy("h").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low < high").select("h"), "several")
    shared = stored(postings.join(several, "h", "left_semi").select("h", "row", F.col("p").cast("long").alias("p")), "shared")
    named = rows.where("prefix is not null").select("row", "k1", "k2", "n").join(classes.select("k1", "k2", "class"), ["k1", "k2"]).select("row", "class", "n")
    # several tasks may have given a class's prefix
    lists = stored(often(shared.join(named, "row").groupBy("class", "h", "n", "p").agg(F.count("*").alias("rows")).drop("rows"), percent), "lists")
    emptied(several, shared)
    return lists


def components_of(lists: DataFrame, parts: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the classes that link; stored."""
    spark = lists.sparkSession
    labels = stored(spark.createDataFrame([], "node long, label long"), "labels")
    now = open_lists(lists, labels, percent)
    turn, last = 0, False
    while True:
        pairs = stored(leftovers(now, signs, percent) if last else star(now, percent, turn), "pairs")
        found = counted(pairs, parts, signs, percent)
        compared, joined = pairs.count(), found.count()
        before = labels
        if joined:
            edges = found.select("a", "b").unionByName(labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))
            labels = components(edges)
            emptied(before)
            if not last:
                earlier, now = now, open_lists(now.drop("label"), labels, percent)
                emptied(earlier)
        emptied(pairs, found)
        if last:
            emptied(now)
            return labels
        last = joined * WORTH <= compared  # also if there was nothing to compare
        turn += 1


def members(docs: DataFrame, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """doc_id, t (name of the text), n and label (a component's name, null without shingles) of every row of ``docs``; stored."""
    counts = sketch(docs)
    level = levels(counts)
    rows = stored(profiles(docs, level, percent), "profiles")
    classes = stored(rows.where("n > 0").groupBy("k1", "k2").agg(F.min("row").alias("class")), "classes")
    lists = class_lists(rows, classes, percent)
    slim = stored(rows.drop("prefix", "row"), "rows")
    emptied(rows)

    wanted = name_filter(classes.join(lists.select("class").distinct(), "class", "left_semi"))
    # dealt by the set's name at once, for the grouping and for the join
    parts = segments(docs, level, fragment_bounds(counts, level, fragments), wanted).repartition("k1", "k2").groupBy("k1", "k2", "fragment").agg(F.first("part").alias("part"))
    parts = stored(parts.join(classes.select("k1", "k2", "class"), ["k1", "k2"]).select("class", "fragment", "part"), "parts")
    signs = stored(parts.where("fragment < 0").select("class", F.col("part").alias("sign")), "signs")
    labels = components_of(lists, parts.where("fragment >= 0"), signs, percent)

    of_class = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").select("k1", "k2", F.coalesce("label", "class").alias("label"))
    out = stored(slim.join(of_class, ["k1", "k2"], "left").select("doc_id", "t", "n", F.when(F.col("n") > 0, F.col("label")).alias("label")), "members")
    emptied(classes, lists, slim, parts, signs, labels)
    return out


def linked(docs: DataFrame, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    rows = members(docs, percent, fragments)
    first = rows.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(first, "label", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each group with all its columns: the one with the smallest id, then the smallest name of its text.

    Rows without an id come last in a group. Of rows with equal id and text one stays. Rows without words link with nothing and all stay.
    """
    found = members(docs, percent)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t")
    best = stored(found.where("label is not null").groupBy("label").agg(F.min(order).alias("b")).select(F.col("b.doc_id").alias("_id"), F.col("b.t").alias("_t")), "best")
    emptied(found)
    worded = text_or_empty().rlike(f"[^{SPACE}]")
    names = docs.columns
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id").cast("long").alias("_own"), text_name().alias("_name"), worded.alias("_worded"))
    # equal rows meet once a task, so that even a third of all rows leaves no big group behind
    mine = once(named.where("_worded"))
    same = (F.col("_name") == F.col("_t")) & F.col("_own").eqNullSafe(F.col("_id"))
    kept = mine.join(best, same).withColumn("_place", F.row_number().over(Window.partitionBy("_name", "_own").orderBy(F.lit(0)))).where("_place = 1")
    back = lambda df: df.select(*[F.col("_row").getField(c).alias(c) for c in names])
    return back(kept).unionByName(back(named.where("not _worded")))


def once(rows: DataFrame) -> DataFrame:
    """``rows`` (_own, _name and more) without those that repeat an earlier one of their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            keys = list(zip(batch.column("_own").to_pylist(), batch.column("_name").to_pylist(), strict=True))
            new = []
            for key in keys:
                new.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(new, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def op10(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))


def sql() -> str:
    """The same rows by joining all shingles of all sets."""
    return f"""
WITH RECURSIVE rows_of AS (
    SELECT row_number() OVER () AS r, doc_id, {words_sql()} AS w FROM documents
), sets AS (
    SELECT DISTINCT r, unnest({shingles_sql(f"least({SHINGLE_WORDS}, len(w))")}) AS s FROM rows_of WHERE len(w) > 0
), sizes AS (
    SELECT r, count(*) AS n FROM sets GROUP BY r
), shared AS (
    SELECT a.r AS a, b.r AS b, count(*) AS both_have FROM sets a JOIN sets b ON a.s = b.s AND a.r <> b.r GROUP BY a.r, b.r
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * both_have >= {PERCENT} * (x.n + y.n - both_have)
), reached AS (
    SELECT r, r AS other FROM rows_of UNION SELECT reached.r, links.b FROM reached JOIN links ON links.a = reached.other
), firsts AS (
    SELECT reached.r, min(o.doc_id) AS component_id FROM reached JOIN rows_of o ON o.r = reached.other GROUP BY reached.r
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM rows_of JOIN firsts USING (r) LEFT JOIN sizes USING (r)
"""
