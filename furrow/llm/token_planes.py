"""Token ids in a binary format of shuffled planes.

Documents are put in key order, encoded, and their ids written as chunks: a chunk is a row that holds whole
documents, cut into blocks of a fixed number of ids. A block is transposed into planes, one for each byte
position or one for each bit position of its ids, and each plane is compressed with zstandard. Planes of high bytes or bits
are nearly constant, so they shrink to almost nothing. The row also is its own index entry: first key, documents, ids and the
place of its first id in its part. The number of all ids before a part follows from the parts' totals.

Spark writes the chunk rows as Parquet files, so a lost task is written again and half-written files never
count, on any file system that Spark can write.

The query encodes as the library does by default: an added token's string in a text, such as <|endoftext|>, is that token's id.
A null or empty text has no ids but its end id. Null keys come first; equal keys are ordered by text.
An empty table gives no chunks. The input's other columns are not read.
"""

from __future__ import annotations

import json
import os
import struct
import sys
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.llm.common import new_path, text_or_empty
from furrow.llm.pieces import CACHE_ENTRIES, Encoded, grouped

#: Signs that the pattern makes words of their own behind letters.
SIGNS = frozenset(".,;:!?")
CHUNK_SCHEMA = "part int, chunk int, first_id long, n_ids long, keys array<long>, lengths array<long>, blocks array<array<binary>>"


@dataclass(frozen=True)
class Layout:
    """How ids become bytes. ``planes`` is ``byte`` or ``bit``; ``width`` bytes hold an id."""

    planes: str = "byte"
    width: int = 4
    block_ids: int = 16_384
    chunk_ids: int = 131_072
    level: int = 3


def to_planes(ids: np.ndarray, layout: Layout, pack) -> list[bytes]:
    """Compressed planes of one block."""
    rows = ids.astype(f"<u{layout.width}").view(np.uint8).reshape(-1, layout.width)
    if layout.planes == "bit":
        bits = np.unpackbits(rows, axis=1, bitorder="little")
        return [pack(np.packbits(bits[:, k], bitorder="little").tobytes()) for k in range(8 * layout.width)]
    return [pack(rows[:, k].tobytes()) for k in range(layout.width)]


def from_planes(planes: list[bytes], n: int, layout: Layout, unpack) -> np.ndarray:
    """The inverse for a block of ``n`` ids."""
    if layout.planes == "bit":
        bits = np.stack([np.unpackbits(np.frombuffer(unpack(p), np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        rows = np.packbits(bits, axis=1, bitorder="little")
    else:
        rows = np.stack([np.frombuffer(unpack(p), np.uint8) for p in planes], axis=1)
    return np.ascontiguousarray(rows).view(f"<u{layout.width}").ravel()


def _compressor(level: int):
    return zstandard.ZstdCompressor(level=level).compress


def _chunk(part: int, number: int, before: int, keys: list, docs: list[np.ndarray], layout: Layout, pack) -> dict:
    ids = np.concatenate(docs)
    blocks = [to_planes(ids[i : i + layout.block_ids], layout, pack) for i in range(0, len(ids), layout.block_ids)]
    return {"part": part, "chunk": number, "first_id": before, "n_ids": len(ids), "keys": keys, "lengths": [len(d) for d in docs], "blocks": blocks}


def byte_alphabet() -> dict[int, str]:
    """Byte-level tokenizers write printable Latin-1 characters as they are and the other bytes from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(other)}


def with_added(encode: Callable[[list[str]], list[bytes]], tokenizer, added: list[dict]) -> Callable[[list[str]], list[bytes]]:
    """``encode`` for texts that are first cut at the tokenizer's added tokens, the longest at a place, as the library does."""
    tokens = {t["content"]: struct.pack("<I", t["id"]) for t in added}
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(tokens, key=len, reverse=True))) + ")").split
    # tokens that take white space along or stand as words only, and those sought in normalized text, are left to the library
    plain = tokenizer.normalizer is None and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)

    def whole(text: str) -> bytes:
        found = tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    def run(texts: list[str]) -> list[bytes]:
        if not plain:
            return [whole(t) for t in texts]
        # ordinary parts and added tokens in turn; no part sees a space of another
        parts = [cut(t) if any(x in t for x in tokens) else [t] for t in texts]
        found = iter(encode([x for c in parts for x in c[::2]]))
        return [b"".join(tokens[x] if k % 2 else next(found) for k, x in enumerate(c)) for c in parts]

    return run


@lru_cache(maxsize=1)
def disputed_letters() -> frozenset[str]:
    """Characters that are letters to Python alone, not to the pattern."""
    every = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha())
    return frozenset(every).difference(regex.findall(r"\p{L}", every))


def plain_words(piece: str) -> tuple[str, ...] | None:
    """What the pattern cuts a piece of letters, with a sign behind them or none, into; None for other pieces."""
    letters, sign = piece.removeprefix(" "), ""
    if letters[-1:] in SIGNS:
        letters, sign = letters[:-1], letters[-1:]
    if not letters.isalpha() or not (letters.isascii() or disputed_letters().isdisjoint(letters)):
        return None
    return (piece[:-1], sign) if sign else (piece,)


@lru_cache(maxsize=2)
def library_encoder(path: str, added_tokens: bool = False) -> Callable[[list[str]], list[bytes]]:
    """Texts to ids by the tokenizers library; strings of added tokens in a text are those tokens if ``added_tokens``, else ordinary text.

    The library's own splitting costs most of its time, so pieces are split here by the same pattern and the library's model
    merges each distinct word once.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    find, merge = regex.compile(public_tokenizers.PATTERN).findall, tokenizer.model.tokenize
    alphabet = byte_alphabet()
    words: dict[str, bytes] = {}

    def ids(word: str) -> bytes:
        if word.isascii() and word.isprintable():
            mapped = word.replace(" ", alphabet[32])  # the others stand for themselves
        else:
            mapped = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(alphabet)
        found = [token.id for token in merge(mapped)]
        return struct.pack(f"<{len(found)}I", *found)

    def encode(new: list[str]) -> list[bytes]:
        """The pieces' words, each distinct one merged by the library once."""
        if len(words) > CACHE_ENTRIES:
            words.clear()
        cut = [plain_words(x) or find(x) for x in new]
        missing = [x for x in set().union(*cut) if x not in words]
        words.update(zip(missing, map(ids, missing), strict=True))
        get = words.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    added = []
    if added_tokens:
        with open(path, encoding="utf-8") as file:
            added = json.load(file).get("added_tokens") or []
    return with_added(Encoded(encode), tokenizer, added) if added else Encoded(encode)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, layout: Layout = Layout(), added_tokens: bool = False) -> None:
    """Encode ``docs`` (doc_id, text) in key order and write the chunks; ``added_tokens`` as in library_encoder."""
    if layout.planes not in ("bit", "byte"):
        raise ValueError("planes are bit or byte")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, pack = library_encoder(tokenizer, added_tokens), _compressor(layout.level)
        part, number, before, held = TaskContext.get().partitionId(), 0, 0, 0
        keys, ids, schema = [], [], _arrow_schema()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for s in grouped(pc.binary_length(batch.column(1)).to_pylist()):
                some = batch.slice(s.start, s.stop - s.start).to_pydict()
                for key, raw in zip(some["doc_id"], encode(some["text"]), strict=True):
                    ids.append(np.frombuffer(raw + end, "<u4"))
                    keys.append(key)
                    held += len(ids[-1])
                    if held >= layout.chunk_ids:
                        yield pa.RecordBatch.from_pylist([_chunk(part, number, before, keys, ids, layout, pack)], schema)
                        number, before, held, keys, ids = number + 1, before + held, 0, [], []
        if keys:
            yield pa.RecordBatch.from_pylist([_chunk(part, number, before, keys, ids, layout, pack)], schema)

    # doc_id and the text's checksum order the rows; the range bounds come from doc_id alone
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.crc32(F.col("text").cast("binary")))
    ordered.mapInArrow(chunks, CHUNK_SCHEMA).write.option("compression", "none").option("parquet.block.size", 8 << 20).parquet(path)


def _arrow_schema() -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("keys", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("blocks", pa.list_(pa.list_(pa.binary())))])


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK_SCHEMA).parquet(path)


def decoded(row_lengths: list[int], blocks: list[list[bytes]], layout: Layout, unpack) -> list[np.ndarray]:
    """The documents' ids of one chunk."""
    total = sum(row_lengths)
    sizes = [min(layout.block_ids, total - i) for i in range(0, total, layout.block_ids)]
    ids = np.concatenate([from_planes(b, n, layout, unpack) for b, n in zip(blocks, sizes, strict=True)])
    return np.split(ids, np.cumsum(row_lengths)[:-1])


def read_documents(spark: SparkSession, path: str, layout: Layout = Layout(), with_ids: bool = False) -> DataFrame:
    """A row for each stored document: key, place of its first id, number of ids, checksum, and the ids if asked for.

    Chunks are decoded where they are read. Only the parts' totals meet in one task; their number is the number of
    written files.
    """

    schema = "part int, doc_id long, in_part long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in range(batch.num_rows):
                x = batch.slice(row, 1).to_pylist()[0]
                docs = decoded(x["lengths"], x["blocks"], layout, unpack)
                starts = x["first_id"] + np.cumsum([0, *x["lengths"][:-1]])
                out = [
                    pa.array([x["part"]] * len(docs), pa.int32()),
                    pa.array(x["keys"], pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array(x["lengths"], pa.int64()),
                    pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in docs], pa.int64()),
                ]
                names = ["part", "doc_id", "in_part", "n_tokens", "ids_crc32"]
                if with_ids:
                    out, names = [*out, pa.array([d.astype(np.int32) for d in docs], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(out, names)

    chunks = read_chunks(spark, path)
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before.alias("before"))
    rows = chunks.select("part", "first_id", "keys", "lengths", "blocks").mapInArrow(documents, schema)
    more = ["ids"] if with_ids else []
    return rows.join(parts, "part").select("doc_id", (F.col("before") + F.col("in_part")).alias("start"), "n_tokens", "ids_crc32", *more)


def op1(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-planes")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)
    return read_documents(spark, path)
