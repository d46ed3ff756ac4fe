"""Byte-level BPE by ranks, with a segment tree over byte positions.

A segment tree over a piece's byte positions stores at each leaf the rank of the pair that begins at the live
token there, and in each inner node the smaller of its children, the left one on ties. The root is the
leftmost pair of minimum rank. A merge removes the right token of the pair and updates the leaves of the merged token and of its live
left neighbour, each along one path to the root, so a piece of n bytes costs n log n whatever its shape.

Pieces of one tree size are merged together: a numpy row each, one merge for every row in a step. Distinct pieces are
encoded once for each worker and batch.

Null and empty texts have no ids. Repeated rows, ties and other columns have no influence. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from furrow.llm.common import text_or_empty
from furrow.llm.pieces import Encoded, grouped

NO_PAIR = 2**31 - 1
#: Rows that are merged together, times bytes of a row.
GROUP_BYTES = 1 << 20
#: From this tree size on, pieces are merged one by one: few pieces are as long.
ALONE = 256


class Ranks:
    """A vocabulary of byte strings with ranks, and the rank of every mergeable pair of its tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.of_bytes = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {v: k for k, v in self.of_bytes.items()}
        self.split = regex.compile(pattern)
        self.byte_ids = np.array([self.of_bytes[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in self.of_bytes.items():
            for cut in range(1, len(token)):
                left, right = self.of_bytes.get(token[:cut]), self.of_bytes.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        # open addressing in two arrays, so that many pairs are looked up at once
        self.bits = int(np.ceil(np.log2(4 * len(pairs) + 4)))
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NO_PAIR, np.int64)
        keys, ranks = np.fromiter(pairs.keys(), np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        slot, self.steps = self._slot(keys), 0
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == -1)
            at, first = np.unique(slot[free], return_index=True)
            self.keys[at], self.ranks[at] = keys[free[first]], ranks[free[first]]
            left = np.ones(len(keys), bool)
            left[free[first]] = False
            keys, ranks, slot = keys[left], ranks[left], (slot[left] + 1) & ((1 << self.bits) - 1)
            self.steps += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of token ids; NO_PAIR if it can't merge or either id is negative."""
        keys = np.where((left < 0) | (right < 0), -2, left << 32 | right)
        out, slot, open_ = np.full(len(keys), NO_PAIR, np.int64), self._slot(keys), np.arange(len(keys))
        for _ in range(self.steps):
            found = self.keys[slot]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slot[hit]]
            go = ~hit & (found != -1)
            if not go.any():
                break
            open_, slot = open_[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out


def merge_rows(raw: list[bytes], vocabulary: Ranks) -> list[np.ndarray]:
    """Ids of pieces whose trees have the same size."""
    size = 1 << max(1, (max(map(len, raw)) - 1).bit_length())
    n = len(raw)
    lengths = np.array([len(r) for r in raw])
    ids = np.full((n, size + 1), -1, np.int64)  # one more column, so that every position has a right side
    text = np.frombuffer(b"".join(r.ljust(size, b"\0") for r in raw), np.uint8).reshape(n, size)
    ids[:, :size] = vocabulary.byte_ids[text]
    ids[:, :size][np.arange(size) >= lengths[:, None]] = -1
    after = np.tile(np.arange(1, size + 2), (n, 1))  # next live position
    after[after > lengths[:, None]] = size
    before = np.tile(np.arange(-1, size), (n, 1))  # live position before
    # tree[1] is the root, tree[size + p] the leaf of position p; a node holds rank << 32 | position
    tree = np.full((n, 2 * size), NO_PAIR << 32, np.int64)
    tree[:, size:] = vocabulary.pair(ids[:, :size].ravel(), ids[:, 1:].ravel()).reshape(n, size) << 32 | np.arange(size)
    for node in range(size - 1, 0, -1):
        np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])

    def update(rows: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> None:
        node = at + size
        tree[rows, node] = ranks << 32 | at
        node >>= 1
        while node[0]:
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            node >>= 1

    live = np.flatnonzero(tree[:, 1] >> 32 < NO_PAIR)
    while len(live):
        root = tree[live, 1]
        at, rank = root & 0xFFFFFFFF, root >> 32
        right = after[live, at]
        follow = after[live, right]
        ids[live, at], ids[live, right], after[live, at] = rank, -1, follow
        before[live, follow] = at
        update(live, right, np.full(len(live), NO_PAIR, np.int64))
        update(live, at, vocabulary.pair(rank, ids[live, follow]))
        left = before[live, at]
        has = left >= 0
        if has.any():
            rows, left = live[has], left[has]
            update(rows, left, vocabulary.pair(ids[rows, left], rank[has]))
        live = live[tree[live, 1] >> 32 < NO_PAIR]
    kept = ids[:, :size] >= 0
    return np.split(ids[:, :size][kept], np.cumsum(kept.sum(1))[:-1])


def merge_one(raw: bytes, vocabulary: Ranks) -> list[int]:
    """Ids of one piece by the same tree, in lists."""
    n = len(raw)
    size = 1 << max(1, (n - 1).bit_length())
    ids, after, before = [int(vocabulary.byte_ids[b]) for b in raw], list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [NO_PAIR << 32] * (2 * size)
    first = np.array(ids, np.int64)
    tree[size : size + n - 1] = (vocabulary.pair(first[:-1], first[1:]) << 32 | np.arange(n - 1)).tolist()
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def update(at: int, rank: int) -> None:
        node = at + size
        tree[node] = rank << 32 | at
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break
            tree[node] = least

    def pair(left: int, right: int) -> int:
        return vocabulary.pairs.get(ids[left] << 32 | ids[right], NO_PAIR) if left >= 0 and right < n else NO_PAIR

    while (root := tree[1]) >> 32 < NO_PAIR:
        at = root & 0xFFFFFFFF
        right = after[at]
        follow = after[right]
        ids[at], ids[right], after[at] = root >> 32, -1, follow
        if follow < n:
            before[follow] = at
        update(right, NO_PAIR)
        update(at, pair(at, follow))
        if before[at] >= 0:
            update(before[at], pair(before[at], at))
    return [i for i in ids if i >= 0]


def encode_pieces(new: list[bytes], vocabulary: Ranks) -> dict[bytes, tuple[int, ...]]:
    """Ids of every distinct piece; a piece that is a token is that token."""
    out = {p: (vocabulary.of_bytes[p],) for p in new if p in vocabulary.of_bytes}
    by_size: dict[int, list[bytes]] = {}
    for p in new:
        if p not in out:
            by_size.setdefault((len(p) - 1).bit_length(), []).append(p)
    for bits, group in by_size.items():
        if 1 << bits >= ALONE:
            out.update((p, tuple(merge_one(p, vocabulary))) for p in group)
            continue
        step = max(1, GROUP_BYTES >> bits)
        for i in range(0, len(group), step):
            rows = group[i : i + step]
            out.update(zip(rows, map(tuple, (r.tolist() for r in merge_rows(rows, vocabulary))), strict=True))
    return out


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> tuple[Ranks, Encoded]:
    """The vocabulary, and text pieces to ids as little-endian 32-bit numbers; one for each worker."""
    vocabulary = Ranks(path, pattern)

    def encode(new: list[str]) -> list[bytes]:
        cut = [[p.encode("utf-8", "surrogatepass") for p in vocabulary.split.findall(x)] for x in new]
        ids = encode_pieces(list(set().union(*cut)), vocabulary)
        return [np.array([i for p in c for i in ids[p]], "<u4").tobytes() for c in cut]

    return vocabulary, Encoded(encode)


def decode(ids: list[int], vocabulary: Ranks) -> bytes:
    return b"".join(map(vocabulary.bytes_of.__getitem__, ids))


def encode(docs: DataFrame, path: str, pattern: str, ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Add ids, their number, their digest and the digest of what they decode to.

    ``keep`` names columns that stay; the new ones are n_tokens, ids_sha256, decoded_sha256 and ids. A kept column of such a name is replaced.
    """
    made = StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
    keep = tuple(c for c in keep if c not in made.names)
    packed = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("_"))  # columns of any name
    kept = docs.select(packed.alias("_row"), text_or_empty().alias("_text"))
    kept_columns = 1
    schema = StructType([*kept.schema.fields[:-1], *made.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, to_ids = encoder(path, pattern)
        decimal = [str(i) for i in range(max(vocabulary.bytes_of) + 1)]
        last = kept_columns
        for whole in batches:
            for s in grouped(pc.binary_length(whole.column(last)).to_pylist()):
                batch = whole.slice(s.start, s.stop - s.start)
                counts, of_ids, of_bytes, arrays = [], [], [], []
                for raw in to_ids(batch.column(last).to_pylist()):
                    row = np.frombuffer(raw, "<u4")
                    numbers = row.tolist()
                    counts.append(len(numbers))
                    of_ids.append(hashlib.sha256(",".join(map(decimal.__getitem__, numbers)).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(decode(numbers, vocabulary)).hexdigest())
                    arrays.append(row.astype(np.int32) if ids else None)
                out = [*batch.columns[:last], pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)]
                names = [*batch.schema.names[:last], "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    out, names = [*out, pa.array(arrays, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    out = kept.mapInArrow(run, schema)
    return out.select(*[F.col("_row").getField(c).alias(c) for c in keep], *made.names)


def op4(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False, keep=("doc_id",))
